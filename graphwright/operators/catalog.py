"""Catalogue queries: skills with their facts, filters, look-ups and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.terms import compact, local_name, requirement_type, snake
from graphwright.operators.closure import closure, reached_from, reached
from graphwright.operators.triples import as_long, facts, of_class, star

#: Trust tiers in the order in which they are preferred, and their weights in searches. Fixed values.
TIERS = ("official", "local", "verified", "community")
WEIGHTS = {"official": 1.2, "local": 1.0, "verified": 1.0, "community": 0.8}
# The dimensions of knowledge and their kinds; operational kinds have no dimension.
DIMENSIONS = {
    "NormativeRule": ("Standard", "AntiPattern", "Constraint"),
    "StrategicInsight": ("Heuristic", "DesignPrinciple", "WorkflowStrategy"),
    "ResilienceTactic": ("KnownIssue", "RecoveryTactic"),
    "ExecutionPhysics": ("Idempotency", "SideEffect", "PerformanceProfile"),
    "Observability": ("SuccessIndicator", "TelemetryPattern"),
    "SecurityGuardrail": ("SecurityImplication", "DestructivePotential", "FallbackStrategy"),
    "CognitiveBoundary": ("RequiresHumanClarification", "AssumptionBoundary", "AmbiguityTolerance"),
    "ResourceProfile": ("TokenEconomy", "ComputeCost"),
    "TrustMetric": ("ExecutionDeterminism", "DataProvenance"),
    "LifecycleHook": ("PreFlightCheck", "PostFlightValidation", "RollbackProcedure"),
}
OPERATIONAL = ("Procedure", "CodePattern", "OutputFormat", "Command", "Prerequisite")
# Notes that come with a payload, and without one.
SAFETY_NOTES = ("Payload execution is delegated to the calling agent.", "The MCP server does not execute code.")
NO_PAYLOAD = ("Skill has no execution payload.",)


def class_tree() -> list[tuple[str, str]]:
    """(sub, super) of the fixed class tree."""
    rows = [("ExecutableSkill", "Skill"), ("DeclarativeSkill", "Skill")]
    rows += [(d, "KnowledgeNode") for d in DIMENSIONS] + [(k, d) for d, kinds in DIMENSIONS.items() for k in kinds] + [(k, "KnowledgeNode") for k in OPERATIONAL]
    return [(f"oc:{a}", f"oc:{b}") for a, b in rows]


def subclass_edges(spark) -> DataFrame:
    """(sub, super): the fixed class tree, a small local table."""
    return spark.createDataFrame(class_tree(), "sub string, super string")


def superclasses(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """What each class of a class tree falls under, itself included, sorted. For trees as small as vocabularies are."""
    up: dict[str, set[str]] = {}
    for sub, sup in pairs:
        up.setdefault(sub, {sub}).add(sup)
        up.setdefault(sup, {sup})
    grown = True
    while grown:
        grown = False
        for above in up.values():
            more = set().union(*(up[c] for c in above)) - above
            if more:
                above |= more
                grown = True
    return {c: sorted(above) for c, above in up.items()}


def skills(t: DataFrame) -> DataFrame:
    """One wide row for each skill, built by one aggregation over the triples, not by queries for each skill.

    Subjects with an identifier and a nature count. Several values are sorted arrays without repeats.
    """
    wide = star(
        t,
        ["dcterms:identifier", "oc:nature", "oc:hasCategory", "oc:inPackage", "oc:trustTier", "oc:isUserInvocable", "oc:version", "skos:broader", "oc:differentia"],
        ["rdf:type", "oc:resolvesIntent", "oc:requiresState", "oc:yieldsState", "oc:extends", "oc:dependsOnSkill", "oc:contradicts", "oc:hasAlias"],
    ).where("identifier is not null and nature is not null")
    kind = F.when(F.array_contains("type", "oc:ExecutableSkill"), "executable").when(F.array_contains("type", "oc:DeclarativeSkill"), "declarative").otherwise("unknown")
    package, tier = F.coalesce("inPackage", F.lit("local")), F.coalesce("trustTier", F.lit("local"))
    return wide.select(
        F.col("s").alias("uri"),
        F.col("identifier").alias("id"),
        F.concat_ws("/", package, "identifier").alias("qualified_id"),
        package.alias("package_id"),
        tier.alias("trust_tier"),
        kind.alias("skill_type"),
        "nature",
        F.col("hasCategory").alias("category"),
        F.coalesce(F.col("isUserInvocable").try_cast("boolean"), F.lit(True)).alias("is_user_invocable"),
        F.col("resolvesIntent").alias("intents"),
        F.col("requiresState").alias("requires_state"),
        F.col("yieldsState").alias("yields_state"),
        F.col("extends"),
        F.col("dependsOnSkill").alias("depends_on"),
        F.col("contradicts"),
        F.col("hasAlias").alias("aliases"),
        F.col("broader").alias("genus"),
        "differentia",
    )


def find_by_intent(skills_wide: DataFrame, intent: str) -> DataFrame:
    """Skills that resolve an intent, in any case."""
    return skills_wide.where(F.exists("intents", lambda i: F.lower(i) == intent.lower()))


def limit_of(limit: int) -> int:
    """0 is 25, 100 is the most."""
    return min(limit or 25, 100)


def search(skills_wide: DataFrame, intent: str | None = None, requires: str | None = None, yields: str | None = None, category: str | None = None, skill_type: str | None = None, invocable: bool | None = None, limit: int = 0) -> DataFrame:
    """Skills that satisfy all filters given, with the names of the filters, or `all`; the first `limit` by qualified id."""
    conditions: list[tuple[str, Column]] = []
    if skill_type:
        conditions.append(("skill_type", F.col("skill_type") == skill_type))
    if category:
        conditions.append(("category", F.col("category") == category))
    if invocable is not None:
        conditions.append(("is_user_invocable", F.col("is_user_invocable") == invocable))
    if intent:
        conditions.append(("intent", F.exists("intents", lambda i: F.lower(i) == intent.lower())))
    if requires:
        conditions.append(("requires_state", F.array_contains("requires_state", requires)))
    if yields:
        conditions.append(("yields_state", F.array_contains("yields_state", yields)))
    out = skills_wide
    for _, c in conditions:
        out = out.where(c)
    matched = F.array(*[F.lit(n) for n, _ in conditions]) if conditions else F.array(F.lit("all"))
    return out.withColumn("matched_by", matched).orderBy("qualified_id").limit(limit_of(limit))


def resolve(references: DataFrame, skills_wide: DataFrame, column: str = "ref") -> DataFrame:
    """(ref, uri, level) of the best skill for each reference, in any case of letters.

    Level 1: the qualified id; 2: package and id, split at the first slash; 3: the id or an alias. Of several on a level the
    preferred trust tier comes first, then package and id. Three equality joins and a window for each reference.
    """
    wanted = references.select(F.col(column).alias("ref")).distinct().withColumn("key", F.lower("ref"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("trust_tier")), F.lit(0))
    named = skills_wide.select("uri", "id", "package_id", F.when(rank == 0, 5).otherwise(rank).alias("tier"), F.lower("qualified_id").alias("qualified"), F.lower("id").alias("short"), F.transform("aliases", F.lower).alias("names"))
    keys = named.select("uri", "id", "package_id", "tier", F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(1).alias("level"), F.col("qualified").alias("key")), F.struct(F.lit(2).alias("level"), F.concat_ws("/", F.lower("package_id"), "short").alias("key")), F.struct(F.lit(3).alias("level"), F.col("short").alias("key"))), F.transform("names", lambda a: F.struct(F.lit(3).alias("level"), a.alias("key")))))).alias("k"))
    keys = keys.select("uri", "id", "package_id", "tier", "k.level", "k.key")
    best = Window.partitionBy("ref").orderBy("level", "tier", "package_id", "id", "uri")
    return wanted.join(keys, "key").withColumn("n", F.row_number().over(best)).where("n = 1").select("ref", "uri", "level")


def yielding(skills_wide: DataFrame, state: str) -> DataFrame:
    """Skills that yield a state."""
    return skills_wide.where(F.array_contains("yields_state", state))


def requirements(t: DataFrame) -> DataFrame:
    """(uri, requirement, requirement_type, value, optional): requirements that have all three facts."""
    held = facts(t, "oc:hasRequirement", "uri", "requirement")
    kinds = facts(t, "rdf:type", "requirement", "kind").where(F.contains("kind", F.lit("Requirement")))
    values, optional = facts(t, "oc:requirementValue", "requirement", "value"), facts(t, "oc:isOptional", "requirement", "optional")
    nodes = kinds.join(values, "requirement").join(optional, "requirement")
    return held.join(nodes, "requirement").select("uri", "requirement", requirement_type(F.col("kind")).alias("requirement_type"), "value", F.col("optional").try_cast("boolean").alias("optional"))


def related_ids(t: DataFrame, predicate: str) -> DataFrame:
    """(uri, related): the identifier of each target of a relation, or its compact term where it has none."""
    targets = facts(t, predicate, "uri", "target")
    ids = facts(t, "dcterms:identifier", "target", "id")
    return targets.join(ids, "target", "left").select("uri", F.coalesce("id", compact(F.col("target"))).alias("related"))


def payloads(t: DataFrame) -> DataFrame:
    """(uri, executor, code, timeout, available): payloads; one without executor or code isn't available."""
    held = facts(t, "oc:hasPayload", "uri", "payload")
    wide = star(t, ["oc:executor", "oc:code", "oc:timeout", "oc:executionPath"]).withColumnRenamed("s", "payload")
    out = held.join(wide, "payload", "left").withColumn("timeout", as_long(F.col("timeout")))
    return out.withColumn("available", F.col("executor").isNotNull() & F.col("code").isNotNull()).withColumn("safety_notes", F.when(F.col("available"), F.array(*map(F.lit, SAFETY_NOTES))).otherwise(F.array(*map(F.lit, NO_PAYLOAD))))


def knowledge(t: DataFrame, inherited: bool = True) -> DataFrame:
    """One row for each skill and knowledge node that it imparts, itself or by what it extends; its own row beats an inherited one.

    kind is the node's least type besides KnowledgeNode, in snake case; dimension the one of the ten that it falls under. links are the titles of
    what is right instead and the labels of the steps it applies to: sorted, distinct (property, target_title, target_type).
    """
    own = facts(t, "oc:impartsKnowledge", "owner", "node")
    held = own.select(F.col("owner").alias("uri"), "owner", "node", F.lit(False).alias("inherited"))
    if inherited:
        up = closure(facts(t, "oc:extends", "src", "dst"))
        held = held.union(up.join(own, F.col("dst") == F.col("owner")).select(F.col("src").alias("uri"), "owner", "node", F.lit(True).alias("inherited")))
    first = Window.partitionBy("uri", "node").orderBy("inherited", "owner")
    held = held.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    dimension = F.create_map(*[F.lit(x) for d, kinds in DIMENSIONS.items() for k in kinds for x in (f"oc:{k}", d)])
    kinds = facts(t, "rdf:type", "node", "kind").where("kind <> 'oc:KnowledgeNode'").groupBy("node").agg(F.min("kind").alias("kind"))
    wide = star(t, ["oc:directiveContent", "oc:appliesToContext", "oc:severityLevel", "oc:hasRationale", "oc:codeLanguage", "oc:stepOrder"], ["oc:templateVariables"]).withColumnRenamed("s", "node")
    nodes = kinds.join(wide.where("directiveContent is not null"), "node").join(node_links(t), "node", "left")
    return held.join(nodes, "node").select(
        "uri",
        "owner",
        "node",
        "inherited",
        snake(F.substring_index("kind", ":", -1)).alias("kind"),
        dimension[F.col("kind")].alias("dimension"),
        F.col("directiveContent").alias("directive_content"),
        F.col("hasRationale").alias("rationale"),
        F.col("appliesToContext").alias("applies_to_context"),
        F.upper("severityLevel").alias("severity_level"),
        F.col("codeLanguage").alias("code_language"),
        as_long(F.col("stepOrder")).alias("step_order"),
        F.col("templateVariables").alias("template_variables"),
        F.coalesce("links", F.array().cast("array<struct<property:string,target_title:string,target_type:string>>")).alias("links"),
    )


def node_links(t: DataFrame) -> DataFrame:
    """(node, links): where knowledge nodes point to."""
    link = lambda p, title, kind: F.struct(F.lit(p).alias("property"), title.alias("target_title"), kind.alias("target_type"))
    titles = star(t, ["oc:sectionTitle", "oc:codeContent"]).select(F.col("s").alias("target"), F.coalesce("sectionTitle", "codeContent").alias("title"))
    right = facts(t, "oc:correctAlternative", "node", "target").join(facts(t, "rdf:type", "target", "kind"), "target").join(titles, "target").where("title is not null")
    right = right.select("node", link("correctAlternative", F.col("title"), F.substring_index("kind", ":", -1)).alias("link"))
    steps = facts(t, "oc:appliesToStep", "node", "target").join(facts(t, "oc:stepLabel", "target", "label"), "target")
    steps = steps.select("node", link("appliesToStep", F.col("label"), F.lit("WorkflowStep")).alias("link"))
    return right.union(steps).groupBy("node").agg(F.array_sort(F.collect_set("link")).alias("links"))


def epistemic_rules(nodes: DataFrame, kind: str | None = None, dimension: str | None = None, severity: str | None = None, context: str | None = None, limit: int = 0) -> DataFrame:
    """Knowledge rows that satisfy all filters, in order of kind, dimension, owner, node and skill."""
    out = nodes
    if kind:
        out = out.where(F.col("kind") == snake(F.lit(kind)))
    if dimension:
        out = out.where(snake(F.col("dimension")) == snake(F.lit(dimension)))
    if severity:
        out = out.where(F.col("severity_level") == severity.strip().upper())
    if context:
        out = out.where(F.contains(F.lower("applies_to_context"), F.lit(context.lower())))
    return out.orderBy(F.asc_nulls_first("kind"), F.asc_nulls_first("dimension"), "owner", "node", "uri").limit(limit_of(limit))


def section_content(t: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(uri, content_type, section_title, content, language, section_order, block) of code examples and tables in a skill's sections, at any depth.

    `skills` (one column of uris) asks for some skills only. The search goes down from their sections, so it makes a row for a skill and a section of it and no table of all pairs of sections.
    """
    tops = facts(t, "oc:hasSection", "uri", "section")
    if skills is not None:
        tops = tops.join(skills.toDF("uri"), "uri", "left_semi")
    sections = reached_from(facts(t, "oc:hasSubsection", "src", "dst"), tops).toDF("uri", "section")
    blocks = facts(t, "oc:hasContent", "section", "block")
    kinds = facts(t, "rdf:type", "block", "kind").where(F.col("kind").isin("oc:CodeExample", "oc:Table"))
    wide = star(t, ["oc:codeContent", "oc:codeLanguage", "oc:tableMarkdown", "oc:tableCaption", "oc:textContent"]).withColumnRenamed("s", "block")
    titles = star(t, ["oc:sectionTitle", "oc:sectionOrder"]).withColumnRenamed("s", "section")
    table = F.coalesce("tableMarkdown", "textContent")
    content = F.when(F.col("kind") == "oc:CodeExample", F.col("codeContent")).when(F.col("tableCaption").isNotNull(), F.concat_ws("\n", "tableCaption", table)).otherwise(table)
    out = sections.join(blocks, "section").join(kinds, "block").join(wide, "block").join(titles, "section", "left")
    out = out.select("uri", F.when(F.col("kind") == "oc:Table", "table").otherwise("code_example").alias("content_type"), F.col("sectionTitle").alias("section_title"), content.alias("content"), F.col("codeLanguage").alias("language"), as_long(F.col("sectionOrder")).alias("section_order"), "block")
    return out.where(F.trim("content") != "").orderBy("uri", F.coalesce("section_order", F.lit(999)), "block")


def find_named(t: DataFrame, names: DataFrame) -> DataFrame:
    """(name, uri) of the skills that names (one column) mean: by identifier, else by a node's local name, else by the name's letters and digits in lower case as a local name.

    Any node with an identifier counts for the first, nodes with intents for the others. Of several on the best level the least node counts. Unknown and null names have no row.
    """
    asked = names.toDF("name").where("name is not null").distinct()
    by_id = facts(t, "dcterms:identifier", "uri", "key").select("uri", "key", F.lit(1).alias("level"))
    nodes = facts(t, "oc:resolvesIntent", "uri", "x").select("uri").distinct()
    local = nodes.select("uri", F.regexp_replace(local_name(F.col("uri")), "^[A-Za-z]+:", "").alias("key"))
    plain = F.lower(F.translate("name", "-_", ""))
    keys = asked.select("name", F.inline(F.array(F.struct(F.col("name").alias("key"), F.lit(1).alias("level")), F.struct(F.col("name").alias("key"), F.lit(2).alias("level")), F.struct(plain.alias("key"), F.lit(3).alias("level")))))
    known = by_id.union(local.select("uri", "key", F.explode(F.array(F.lit(2), F.lit(3))).alias("level")))
    return keys.join(known, ["key", "level"]).groupBy("name").agg(F.min(F.struct("level", "uri"))["uri"].alias("uri"))


def explain(t: DataFrame, skills_wide: DataFrame) -> DataFrame:
    """Skills with their own knowledge, sorted by kind and node, and the first 8 digits of their content hash."""
    nodes = knowledge(t, inherited=False).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("kind", "node", "directive_content"))).alias("knowledge"))
    hashes = facts(t, "oc:contentHash", "uri", "hash")
    return skills_wide.join(nodes, "uri", "left").join(hashes, "uri", "left").withColumn("hash", F.substring("hash", 1, 8))


def aliases(t: DataFrame, alias: str) -> DataFrame:
    """Subjects of skills with an alias, in any case; letters, digits, hyphen, underscore and blank are allowed."""
    if not alias or any(not (c.isalnum() or c in "-_ ") for c in alias):
        raise ValueError(f"not an alias: {alias!r}")
    return facts(t, "oc:hasAlias", "uri", "alias").where(F.lower("alias") == alias.lower()).join(of_class(t, "oc:Skill").withColumnRenamed("s", "uri"), "uri", "left_semi")


def facet_values(packages: DataFrame) -> DataFrame:
    """(facet, value, n): the authors, categories and tiers of the skills of package documents, and how many skills each has; an author is what comes before a package's slash. Empty and null values count nowhere."""
    rows = packages.select(F.substring_index("package_id", "/", 1).alias("author"), F.col("trust_tier").alias("tier"), F.explode("skills").alias("skill"))
    facets_ = rows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in (("author", F.col("author")), ("category", F.col("skill.category")), ("tier", F.col("tier")))])).alias("f")).select("f.*")
    return facets_.where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def facets(packages: DataFrame, text: str | None = None, tier: str | None = None, category: str | None = None, descending: bool = False, author: str | None = None) -> DataFrame:
    """Skills of package documents (package_id, trust_tier, skills array) by a word in any of their fields, tier, category and author, by id."""
    rows = packages.select("package_id", "trust_tier", F.explode("skills").alias("skill")).select("package_id", "trust_tier", "skill.*")
    words = [c for c, kind in rows.dtypes if kind == "string"]
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *words, *[F.array_join(c, " ") for c, kind in rows.dtypes if kind == "array<string>"])), F.lit(text.lower())))
    if tier:
        rows = rows.where(F.col("trust_tier") == tier)
    if author:
        rows = rows.where(F.substring_index("package_id", "/", 1) == author)
    if category:
        rows = rows.where(F.col("category") == category)
    return rows.orderBy(F.col("id").desc() if descending else F.col("id"))


def context(t: DataFrame, wide: DataFrame, skill_id: str, inherited: bool = True) -> dict:
    """A skill with its payload, knowledge and sections, as one record; LookupError if there is none of this name.

    The skill is resolved first, so that everything else is read for one subject, and what is collected is that of one skill.
    """
    spark = t.sparkSession
    found = resolve(spark.createDataFrame([(skill_id,)], "ref string"), wide).join(wide, "uri").limit(1).collect()
    if not found:
        raise LookupError(f"unknown skill {skill_id!r}")
    skill = found[0].asDict(recursive=True)
    one = lambda df: df.where(F.col("uri") == skill["uri"])
    needs = [r.asDict() for r in one(requirements(t)).orderBy("requirement").collect()]
    load = one(payloads(t)).limit(1).collect()
    ups = reached(facts(t, "oc:extends", "src", "dst"), spark.createDataFrame([(skill["uri"],)], "node string")) if inherited else spark.createDataFrame([(skill["uri"],)], "node string")
    own = t.where(F.col("p") != "oc:impartsKnowledge").union(t.where(F.col("p") == "oc:impartsKnowledge").join(ups.withColumnRenamed("node", "s"), "s", "left_semi").select(t.columns))
    nodes = knowledge(own, inherited=False).withColumn("inherited", F.col("uri") != skill["uri"])
    first = Window.partitionBy("node").orderBy("inherited", "owner")
    nodes = nodes.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "uri").orderBy("node")
    return {
        "skill": {k: v for k, v in skill.items() if k not in ("ref", "level")} | {"requirements": needs},
        "payload": load[0].asDict() if load else {"available": False, "safety_notes": list(NO_PAYLOAD)},
        "knowledge_nodes": [r.asDict(recursive=True) for r in nodes.collect()],
        "sections": [r.asDict() for r in one(section_content(t)).collect()],
        "include_inherited_knowledge": inherited,
    }


def trust_tiers(wide: DataFrame) -> DataFrame:
    """(id, trust_tier): of skills of one id the tier of the last by qualified id."""
    return wide.groupBy("id").agg(F.max_by("trust_tier", "qualified_id").alias("trust_tier"))


def skill_records(found: DataFrame, lock: DataFrame) -> DataFrame:
    """Index records (id, uri, qualified_id, package_id, trust_tier, version, source, aliases) of skills found in module files.

    found: (path, uri, id), a file's path below the root as `path`; lock: (module_path, package_id, trust_tier, version, source, aliases). A file that the lock knows takes
    package and tier from it; another below author/ is verified and its package is the folder there; all others are local. Of records of one
    qualified id the first by path counts. core.ttl has no skills.
    """
    rows = found.where(F.substring_index("path", "/", -1) != "core.ttl").join(lock.withColumnRenamed("module_path", "path").withColumn("locked", F.lit(True)), "path", "left")
    parts = F.split("path", "/")
    authored = (F.element_at(parts, 1) == "author") & (F.size(parts) > 1)
    package = F.when(F.col("locked"), F.col("package_id")).when(authored, F.element_at(parts, 2)).otherwise("local")
    rows = rows.withColumn("package", package).withColumn("tier", F.when(F.col("locked"), F.col("trust_tier")).when(authored, "verified").otherwise("local"))
    rows = rows.select("id", "uri", F.concat_ws("/", "package", "id").alias("qualified_id"), F.col("package").alias("package_id"), F.col("tier").alias("trust_tier"), "version", "source", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "path")
    first = Window.partitionBy("qualified_id").orderBy("path", "uri")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "path")
