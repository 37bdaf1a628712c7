"""A deterministic skill graph over the star-schema tables, as a triple table.

Part k is skill node `oc:skill_k`; documents are knowledge nodes. Each predicate is one projection with a literal in
`p`, so a filter on `p` leaves one branch of the union and its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.triples import TYPE
from graphwright.sources.scratch import spread

TIERS = ("official", "local", "verified", "community")
KINDS = ("Standard", "Heuristic", "KnownIssue", "SideEffect", "Procedure")


def _node(k: Column) -> Column:
    return F.concat(F.lit("oc:skill_"), k.cast("string"))


def skill_triples(part: DataFrame, graph_id: str = "new") -> DataFrame:
    """Triples of the skills of a part table."""
    k = F.col("p_partkey")
    state = lambda n: F.concat(F.lit("oc:S_"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("_"), n.cast("string"))
    ring = F.when(k % 20 < 5, k - k % 5 + (k + 1) % 5).otherwise(k - 1)
    requirement = F.concat(F.lit("oc:req_"), (F.col("p_size") % 3).cast("string"), F.lit("_"), F.regexp_replace("p_brand", "#", "_"))
    size = F.col("p_size")
    literal, iri = "literal", "iri"
    plan: list[tuple[str, Column, str, DataFrame]] = [
        ("dcterms:identifier", F.concat(F.lit("part-"), k.cast("string")), literal, part),
        ("oc:nature", F.col("p_name"), literal, part),
        ("oc:hasCategory", F.col("p_type"), literal, part),
        ("oc:inPackage", F.col("p_brand"), literal, part),
        ("oc:trustTier", F.element_at(F.array(*map(F.lit, TIERS)), (k % 4 + 1).cast("int")), literal, part),
        ("rdf:type", F.lit("oc:Skill"), iri, part),
        ("rdf:type", F.when(size % 2 == 0, F.lit("oc:ExecutableSkill")).otherwise(F.lit("oc:DeclarativeSkill")), iri, part),
        ("oc:resolvesIntent", F.col("word"), literal, part.withColumn("word", F.explode(F.array_distinct(F.split("p_name", " "))))),
        ("oc:extends", _node(F.floor(k / 2)), iri, part.where(k > 0)),
        ("oc:dependsOnSkill", _node(ring), iri, part.where((k % 20 < 5) | (k > 0))),
        ("oc:requiresState", state(size % 12), iri, part),
        ("oc:yieldsState", state((size + 1) % 10), iri, part),
        ("oc:hasRequirement", requirement, iri, part),
    ]
    rows = [df.select(F.lit(graph_id).alias("graph_id"), _node(k).alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")) for p, o, kind, df in plan]
    needs = part.select(requirement.alias("s"), (size % 3).alias("t"), "p_brand").distinct()
    kinds = F.element_at(F.array(*map(F.lit, ("oc:RequirementTool", "oc:RequirementFile", "oc:RequirementEnv"))), (F.col("t") + 1).cast("int"))
    facts = [("rdf:type", kinds, iri), ("oc:requirementValue", F.col("p_brand"), literal), ("oc:isOptional", (F.col("t") == 2).cast("string"), literal)]
    rows += [needs.select(F.lit(graph_id).alias("graph_id"), "s", F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")) for p, o, kind in facts]
    return reduce(DataFrame.union, rows)


def knowledge_triples(documents: DataFrame, labels: DataFrame, skills: int, graph_id: str = "new") -> DataFrame:
    """Triples of the documents as knowledge nodes of `skills` skills: document d belongs to skill d mod skills."""
    node = F.concat(F.lit("oc:kn_"), F.col("doc_id").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    graded = documents.select("doc_id").join(labels, "doc_id")
    severity = F.when(F.col("toxic") == 1, F.lit("CRITICAL")).when(F.col("quality") == 0, F.lit("HIGH")).otherwise(F.lit("LOW"))
    plan = [
        ("oc:impartsKnowledge", _node(F.col("doc_id") % skills), node, "iri", documents),
        ("rdf:type", node, F.concat(F.lit("oc:"), kind), "iri", documents),
        ("oc:directiveContent", node, F.col("text"), "literal", documents),
        ("oc:appliesToContext", node, F.col("source"), "literal", documents),
        ("oc:severityLevel", node, severity, "literal", graded),
    ]
    rows = [df.select(F.lit(graph_id).alias("graph_id"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind_).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")) for p, s, o, kind_, df in plan]
    return reduce(DataFrame.union, rows)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph of a folder of driver tables."""
    part, (documents, labels) = _parts(spark, sf_dir), (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return skill_triples(part).union(knowledge_triples(documents, labels, max(part.count(), 1)))


def old_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills alone, as the base of a comparison."""
    return skill_triples(_parts(spark, sf_dir), "old")


def new_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills without every 50th, and with the intents of every 7th renamed."""
    part = _parts(spark, sf_dir).where("p_partkey % 50 != 0")
    t = skill_triples(part, "new")
    renamed = (F.col("p") == "oc:resolvesIntent") & F.startswith("s", F.lit("oc:skill_")) & (F.when(F.startswith("s", F.lit("oc:skill_")), F.substring_index("s", "_", -1)).try_cast("bigint") % 7 == 0)
    return t.withColumn("o", F.when(renamed, F.concat("o", F.lit("_v2"))).otherwise(F.col("o")))


def content_graph(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    """What skills hold: payloads, aliases, sections with code and tables, notes, and workflows of two steps, each derived from a part. With `predicates`, their facts alone are made; a filter
    afterwards would make all of a part's first."""
    part = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    node = lambda name: F.concat(F.lit(f"oc:{name}_"), k.cast("string"))
    said = lambda text: F.concat(F.lit(text), k.cast("string"))
    one_of = lambda *words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    skill, iri, text = _node(k), "iri", None
    even, loops = k % 2 == 0, k % 7 == 0
    plan: list[tuple[Column, str, Column, str | None, Column | None]] = [
        (skill, "oc:hasPayload", node("pay"), iri, F.col("p_size") % 2 == 0),
        (node("pay"), "rdf:type", F.lit("oc:ExecutionPayload"), iri, F.col("p_size") % 2 == 0),
        (node("pay"), "oc:executor", one_of("shell", "python", "cobol"), text, F.col("p_size") % 2 == 0),
        (node("pay"), "oc:code", said("run "), text, (F.col("p_size") % 2 == 0) & (k % 4 != 0)),
        (node("pay"), "oc:timeout", F.when(k % 10 == 0, said("soon ")).otherwise((k % 60).cast("string")), text, (F.col("p_size") % 2 == 0) & (k % 5 == 0)),
        (skill, "oc:hasAlias", said("al_"), text, k % 10 == 0),
        (skill, "oc:hasSection", node("sec"), iri, None),
        (node("sec"), "rdf:type", F.lit("oc:Section"), iri, None),
        (node("sec"), "oc:sectionTitle", F.col("p_name"), text, None),
        (node("sec"), "oc:sectionOrder", F.lit("1"), text, None),
        (node("sec"), "oc:hasSubsection", node("sub"), iri, None),
        (node("sub"), "rdf:type", F.lit("oc:Section"), iri, None),
        (node("sub"), "oc:sectionTitle", one_of("Best practice", "Details", "Recommended way"), text, None),
        (node("sub"), "oc:sectionOrder", (k % 4 + 2).cast("string"), text, None),
        (node("sub"), "oc:hasContent", node("code"), iri, None),
        (node("code"), "rdf:type", F.lit("oc:CodeExample"), iri, None),
        (node("code"), "oc:codeContent", said("x = "), text, None),
        (node("code"), "oc:codeLanguage", F.lit("python"), text, None),
        (node("sec"), "oc:hasContent", node("tab"), iri, None),
        (node("tab"), "rdf:type", F.lit("oc:Table"), iri, None),
        (node("tab"), "oc:tableMarkdown", said("| a |"), text, k % 3 != 0),
        (node("tab"), "oc:textContent", said("plain "), text, k % 3 == 0),
        (node("tab"), "oc:tableCaption", said("cap "), text, even),
        (skill, "oc:impartsKnowledge", node("note"), iri, None),
        (node("note"), "rdf:type", F.lit("oc:KnowledgeNode"), iri, None),
        (node("note"), "rdf:type", F.when(even, F.lit("oc:AntiPattern")).otherwise(F.lit("oc:Heuristic")), iri, None),
        (node("note"), "oc:directiveContent", said("do "), text, None),
        (node("note"), "oc:appliesToContext", F.when(k % 5 == 0, F.concat(F.lit("see step 0 or #"), (k * 2).cast("string"))).when(k % 5 == 1, F.concat(F.lit("in Label "), k.cast("string"), F.lit(";"))).otherwise(F.col("p_name")), text, None),
        (node("note"), "oc:derivedFromSection", node("sub"), iri, (k % 4 == 0)),
        (node("note"), "oc:derivedFromSection", node("sec"), iri, (k % 4 == 2)),
        (node("note"), "oc:correctAlternative", node("code"), iri, k % 6 == 1),
        (skill, "oc:hasWorkflow", node("wf"), iri, None),
        *[x for n, other in ((1, 2), (2, 1)) for x in (
            (node("wf"), "oc:hasStep", node(f"step{n}"), iri, None),
            (node(f"step{n}"), "rdf:type", F.lit("oc:WorkflowStep"), iri, None),
            (node(f"step{n}"), "oc:stepId", F.lit(str(n)), text, None),
            (node(f"step{n}"), "oc:stepOrder", (k * 2 + n - 1).cast("string"), text, k > 0),
            (node(f"step{n}"), "oc:stepDependsOn", node(f"step{other}"), iri, loops if n == 1 else loops | even),
        )],
        (node("step1"), "oc:stepLabel", F.concat(F.lit("label "), k.cast("string"), F.lit(";")), text, None),
    ]
    none = F.lit(None).cast("string")
    facts = F.array(*[F.struct(F.when(condition if condition is not None else F.lit(True), s).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind or "literal").alias("o_kind")) for s, p, o, kind, condition in plan if not predicates or p in predicates])
    # nulls go after the explode: a lambda over the array would keep it from being compiled
    rows = part.select(F.explode(facts).alias("f")).select("f.*").where("s is not null")
    number = (F.col("p").isin("oc:stepOrder", "oc:sectionOrder")) | ((F.col("p") == "oc:timeout") & ~F.startswith("o", F.lit("soon")))
    return rows.select(F.lit("content").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", F.when(number, F.lit("xsd:integer")).alias("o_dt"), none.alias("o_lang"))


def content_nodes(documents: DataFrame, plan: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Nodes of content, document d one of class d mod classes. `plan` has (class, path, value, its kind or datatype, another datatype); of each path the q-th node of its class lacks it where q is a multiple of 4, has the
    other datatype where q leaves 1 by 5, and has two values where q leaves 2 by 7."""
    classes = list(dict.fromkeys(c for c, *_ in plan))
    q, of = F.floor(F.col("doc_id") / len(classes)), F.col("doc_id") % len(classes)
    node, none = F.concat(F.lit("oc:c_"), F.col("doc_id").cast("string")), F.lit(None).cast("string")
    facts = [F.struct(F.lit(TYPE).alias("p"), F.element_at(F.array(*[F.lit(f"oc:{c}") for c in classes]), (of + 1).cast("int")).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"))]
    for i, (name, path, value, kind, other) in enumerate(plan):
        turn = q + i
        mine = (of == classes.index(name)) & (turn % 4 != 0)
        said = lambda text, kind=kind, other=other, turn=turn: (text.alias("o"), F.lit("iri" if kind == "iri" else "literal").alias("o_kind"), F.when(F.lit(kind != "iri"), F.when(turn % 5 == 1, F.lit(other)).otherwise(F.lit(kind))).alias("o_dt"))
        facts.append(F.when(mine, F.struct(F.lit(f"oc:{path}").alias("p"), *said(F.lit(value)))))
        facts.append(F.when(mine & (turn % 7 == 2), F.struct(F.lit(f"oc:{path}").alias("p"), *said(F.concat(F.lit(value), F.lit("2"))))))
    rows = documents.select(node.alias("s"), F.inline(F.filter(F.array(*facts), lambda f: f.isNotNull())))
    return rows.select(F.lit("content").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", none.alias("o_lang"))


def records(part: DataFrame) -> DataFrame:
    """Structured records of skills, as a compiler makes them, derived from parts; see operators.serialise."""
    k = F.col("p_partkey")
    said = lambda text: F.concat(F.lit(text), k.cast("string"))
    none = F.lit(None).cast("string")
    step = lambda n, needs: F.struct(F.lit(n).alias("step_id"), said(f"step {n} of ").alias("description"), (F.when(k % 2 == 0, said("done ")) if n == "1" else none).alias("expected_outcome"), F.array(*map(F.lit, needs)).cast("array<string>").alias("depends_on"))
    kinds = F.element_at(F.array(*map(F.lit, ("EnvVar", "Tool", "API"))), (k % 3 + 1).cast("int"))
    knowledge = F.element_at(F.array(*map(F.lit, ("Standard", "AntiPattern", "Command"))), (k % 3 + 1).cast("int"))
    return part.select(
        said("part-").alias("id"),
        F.when(k % 2 == 0, F.col("p_brand")).alias("package"),
        F.sha2(k.cast("string"), 256).alias("hash"),
        F.col("p_name").alias("nature"),
        F.col("p_type").alias("genus"),
        said("the one of ").alias("differentia"),
        F.split("p_name", " ").alias("intents"),
        F.array(F.struct(kinds.alias("type"), F.col("p_brand").alias("value"), F.when(k % 2 == 0, F.lit(True)).alias("optional"))).alias("requirements"),
        F.array(said("part-"), F.concat(F.lit("part-"), F.floor(k / 2).cast("string"))).alias("depends_on"),
        F.when(k % 3 == 0, F.array(F.lit("oc:skill_root"))).alias("extends"),
        F.when(k % 5 == 0, F.array(F.lit("http://x.org/s"), F.lit("Some Skill"))).alias("contradicts"),
        F.array(F.concat(F.lit("oc:S"), F.col("p_size").cast("string"))).alias("requires_state"),
        F.array(F.concat(F.lit("Y"), F.col("p_size").cast("string"))).alias("yields_state"),
        F.lit(None).cast("array<string>").alias("handles_failure"),
        F.when(k % 4 == 0, F.struct(F.lit("python").alias("executor"), said("run ").alias("code"), (k % 8).cast("int").alias("timeout"))).alias("payload"),
        F.array(F.struct(knowledge.alias("node_type"), said("do ").alias("directive"), none.alias("rationale"), F.col("p_type").alias("context"), F.lit("high").alias("severity"), none.alias("language"), (k % 9).cast("int").alias("step_order"), F.array(F.lit("v"), said("w")).alias("variables"))).alias("knowledge"),
        F.col("p_type").alias("category"),
        (k % 2 == 0).alias("is_user_invocable"),
        F.array(said("al-")).alias("aliases"),
        F.when(k % 2 == 0, said("hint ")).otherwise("").alias("argument_hint"),
        F.array(F.lit("git"), said("tool")).alias("allowed_tools"),
        F.array(F.struct(F.lit("reference/a.md").alias("relative_path"), F.lit("why").alias("purpose")), F.struct(said("r/").alias("relative_path"), F.lit("how").alias("purpose"))).alias("reference_files"),
        F.array(F.struct(F.lit("reference/a.md").alias("relative_path"), said("h").alias("content_hash"), k.cast("long").alias("file_size"), F.lit("text/markdown").alias("mime_type"))).alias("files"),
        F.array(F.struct(F.lit("w").alias("workflow_id"), said("flow ").alias("name"), none.alias("description"), F.array(step("1", ["9"]), step("2", ["1"])).alias("steps"))).alias("workflows"),
        F.array(F.struct(F.lit("e").alias("name"), said("in ").alias("input_description"), said("out ").alias("output_example"), F.array(F.lit("t")).alias("tags"))).alias("examples"),
    )
