"""Structured skill records to triples, enrichment of records, and merging of graphs.

A record has: id, hash, nature, genus, differentia, intents, requirements (array of type, value, optional), depends_on, extends,
contradicts, requires_state, yields_state, handles_failure, payload (executor, code, timeout), knowledge (array of node_type, directive,
rationale, context, severity, language, step_order and perhaps variables), category, package, is_user_invocable, aliases. Any of them may be null. It may have
argument_hint, allowed_tools, reference_files (relative_path, purpose) with files (relative_path, content_hash, file_size, mime_type), workflows (workflow_id, name, description,
steps of step_id, description, expected_outcome, depends_on) and examples (name, input_description, output_example, tags).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.terms import BASE, hashed_node, skill_uri
from graphwright.operators.links import infer_links
from graphwright.operators.triples import distinct_triples
from graphwright.sources.scratch import drop, stored

LIST = "array<string>"
#: Records whose triples, some 60 of each, one task makes distinct.
RECORDS = 10_000


def _facts(rows: DataFrame, *facts: tuple[str, Column, str, str | None]) -> DataFrame:
    """Triples of a column `s`: (predicate, object, kind, datatype) each; null objects give none. One explode for all."""
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt")) for p, o, kind, dt in facts])
    return rows.select("graph_id", "s", F.explode(F.filter(made, lambda x: x["o"].isNotNull())).alias("f")).select("graph_id", "s", "f.*")


def _each(rows: DataFrame, p: str, values: Column, kind: str) -> DataFrame:
    return rows.select("graph_id", "s", F.explode(F.array_distinct(values)).alias("o")).where("o is not null and o <> ''").select("graph_id", "s", F.lit(p).alias("p"), "o", F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))


def target(relation: Column) -> Column:
    """A related skill's node: http(s) and `oc:` terms as they are, a bare id by its slug."""
    return F.when(relation.rlike("^(https?://|oc:)"), relation).otherwise(skill_uri(relation))


def state(term: Column) -> Column:
    """A state's node."""
    return F.when(term.rlike("^(https?://|oc:)"), term).otherwise(F.concat(F.lit("oc:"), term))


def skill_triples(records: DataFrame) -> DataFrame:
    """All triples of records, in the schema of the triple table; a graph for each skill, named by its id."""
    rows = records.withColumn("s", skill_uri(F.concat_ws("/", F.coalesce("package", F.lit("local")), "id"))).withColumn("graph_id", F.col("id"))
    kind = F.when(F.col("payload").isNotNull(), F.lit("oc:ExecutableSkill")).otherwise(F.lit("oc:DeclarativeSkill"))
    out = [
        _facts(
            rows,
            ("rdf:type", F.lit("oc:Skill"), "iri", None),
            ("rdf:type", kind, "iri", None),
            ("dcterms:identifier", F.col("id"), "literal", "xsd:string"),
            ("oc:contentHash", F.col("hash"), "literal", "xsd:string"),
            ("oc:nature", F.col("nature"), "literal", "xsd:string"),
            ("skos:broader", F.col("genus"), "literal", "xsd:string"),
            ("oc:differentia", F.col("differentia"), "literal", "xsd:string"),
            ("oc:hasCategory", F.col("category"), "literal", "xsd:string"),
            ("oc:inPackage", F.col("package"), "literal", "xsd:string"),
            ("oc:isUserInvocable", F.col("is_user_invocable"), "literal", "xsd:boolean"),
            *([("oc:hasArgumentHint", F.nullif("argument_hint", F.lit("")), "literal", "xsd:string")] if "argument_hint" in rows.columns else []),
        ),
        *([_each(rows, "oc:hasAllowedTool", F.col("allowed_tools"), "literal")] if "allowed_tools" in rows.columns else []),
        _each(rows, "oc:resolvesIntent", F.col("intents"), "literal"),
        _each(rows, "oc:hasAlias", F.col("aliases"), "literal"),
        _each(rows, "oc:dependsOnSkill", F.transform(F.filter("depends_on", lambda x: x != F.col("id")), target), "iri"),
        _each(rows, "oc:extends", F.transform("extends", target), "iri"),
        _each(rows, "oc:contradicts", F.transform("contradicts", target), "iri"),
        _each(rows, "oc:requiresState", F.transform("requires_state", state), "iri"),
        _each(rows, "oc:yieldsState", F.transform("yields_state", state), "iri"),
        _each(rows, "oc:handlesFailure", F.transform("handles_failure", state), "iri"),
    ]
    needs = rows.select("graph_id", F.col("s").alias("skill"), F.explode("requirements").alias("r")).withColumn("s", hashed_node("req", 8, F.col("r.type"), F.col("r.value")))
    out.append(needs.select("graph_id", F.col("skill").alias("s"), F.lit("oc:hasRequirement").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")))
    out.append(_facts(needs, ("rdf:type", F.concat(F.lit("oc:Requirement"), F.col("r.type")), "iri", None), ("oc:requirementValue", F.col("r.value"), "literal", "xsd:string"), ("oc:isOptional", F.coalesce("r.optional", F.lit(False)), "literal", "xsd:boolean")))
    loads = rows.where("payload is not null").select("graph_id", F.col("s").alias("skill"), F.concat(F.lit("oc:payload_"), F.substring("hash", 1, 16)).alias("s"), "payload")
    out.append(loads.select("graph_id", F.col("skill").alias("s"), F.lit("oc:hasPayload").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")))
    out.append(_facts(loads, ("rdf:type", F.lit("oc:ExecutionPayload"), "iri", None), ("oc:executor", F.col("payload.executor"), "literal", "xsd:string"), ("oc:code", F.col("payload.code"), "literal", "xsd:string"), ("oc:timeout", F.when(F.col("payload.timeout") != 0, F.col("payload.timeout")), "literal", "xsd:integer")))
    knows = rows.select("graph_id", F.col("s").alias("skill"), F.explode("knowledge").alias("k")).where("k.node_type is not null and k.directive is not null").withColumn("s", hashed_node("kn", 8, F.col("k.node_type"), F.col("k.directive")))
    out.append(knows.select("graph_id", F.col("skill").alias("s"), F.lit("oc:impartsKnowledge").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")))
    out.append(
        _facts(
            knows,
            ("rdf:type", F.lit("oc:KnowledgeNode"), "iri", None),
            ("rdf:type", F.concat(F.lit("oc:"), F.col("k.node_type")), "iri", None),
            ("oc:directiveContent", F.col("k.directive"), "literal", "xsd:string"),
            ("oc:hasRationale", F.col("k.rationale"), "literal", "xsd:string"),
            ("oc:appliesToContext", F.col("k.context"), "literal", "xsd:string"),
            ("oc:severityLevel", F.upper("k.severity"), "literal", "xsd:string"),
            ("oc:codeLanguage", F.col("k.language"), "literal", "xsd:string"),
            ("oc:stepOrder", F.col("k.step_order"), "literal", "xsd:integer"),
        )
    )
    if "variables" in knows.select("k.*").columns:
        out.append(_each(knows, "oc:templateVariables", F.col("k.variables"), "literal"))
    for made, needed in ((reference_files, "reference_files"), (workflows, "workflows"), (examples, "examples")):
        if needed in rows.columns:
            out.append(made(rows))
    rows = reduce(DataFrame.unionByName, out)
    n = records.count()
    return distinct_triples(rows.select("graph_id", "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang")), -(-n // RECORDS) if n > RECORDS else None)


def content_node(prefix: str, kind: str, *parts: Column) -> Column:
    """The node of a part of a skill's content: the record's hash, the kind of part and what tells it apart."""
    return hashed_node(prefix, 16, F.col("hash"), F.lit(kind), *parts)


def _link(rows: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """A link from a column to another."""
    return rows.select("graph_id", F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")).where("o is not null")


def reference_files(rows: DataFrame) -> DataFrame:
    """Triples of reference files; hash, size and type come from the file of the same path, where there is one."""
    refs = rows.select("graph_id", "hash", F.col("s").alias("skill"), "files" if "files" in rows.columns else F.lit(None).cast("array<struct<relative_path:string,content_hash:string,file_size:bigint,mime_type:string>>").alias("files"), F.explode("reference_files").alias("r"))
    refs = refs.withColumn("s", content_node("ref", "ref", F.col("r.relative_path"))).withColumn("f", F.try_element_at(F.filter("files", lambda f: f["relative_path"] == F.col("r.relative_path")), F.lit(-1)))
    text = "xsd:string"
    return _link(refs, "skill", "oc:hasReferenceFile", "s").union(_facts(
        refs,
        ("rdf:type", F.lit("oc:ReferenceFile"), "iri", None),
        ("oc:filePath", F.col("r.relative_path"), "literal", text),
        ("oc:purpose", F.col("r.purpose"), "literal", text),
        ("oc:fileHash", F.col("f.content_hash"), "literal", text),
        ("oc:fileSize", F.col("f.file_size"), "literal", "xsd:integer"),
        ("oc:fileMimeType", F.col("f.mime_type"), "literal", text),
    ))


def workflows(rows: DataFrame) -> DataFrame:
    """Triples of workflows and their steps. What a step depends on is a link to a step of the same workflow; see `unresolved_steps` for names that are none."""
    text = "xsd:string"
    flows = rows.select("graph_id", "hash", F.col("s").alias("skill"), F.explode("workflows").alias("w")).withColumn("s", content_node("wf", "workflow", F.col("w.workflow_id")))
    out = _link(flows, "skill", "oc:hasWorkflow", "s").union(_facts(flows, ("rdf:type", F.lit("oc:Workflow"), "iri", None), ("oc:workflowId", F.col("w.workflow_id"), "literal", text), ("oc:workflowName", F.col("w.name"), "literal", text), ("dcterms:description", F.col("w.description"), "literal", text)))
    node = lambda step: content_node("step", "step", F.concat_ws("_", F.col("w.workflow_id"), step))
    steps = flows.select("graph_id", "hash", F.col("s").alias("flow"), "w", F.explode("w.steps").alias("t")).withColumn("s", node(F.col("t.step_id")))
    out = out.union(_link(steps, "flow", "oc:hasStep", "s")).union(_facts(steps, ("rdf:type", F.lit("oc:WorkflowStep"), "iri", None), ("oc:stepId", F.col("t.step_id"), "literal", text), ("dcterms:description", F.col("t.description"), "literal", text), ("oc:expectedOutcome", F.nullif("t.expected_outcome", F.lit("")), "literal", text)))
    needs = steps.select("graph_id", "hash", "s", "w", F.explode("t.depends_on").alias("need")).where(F.array_contains("w.steps.step_id", F.col("need"))).withColumn("o", node(F.col("need")))
    return out.union(_link(needs, "s", "oc:stepDependsOn", "o"))


def unresolved_steps(records: DataFrame) -> DataFrame:
    """(id, workflow_id, step_id, need): dependencies on steps that their workflow doesn't have."""
    flows = records.select("id", F.explode("workflows").alias("w"))
    steps = flows.select("id", "w", F.explode("w.steps").alias("t")).select("id", "w", "t", F.explode("t.depends_on").alias("need"))
    return steps.where(~F.array_contains("w.steps.step_id", F.col("need"))).select("id", F.col("w.workflow_id").alias("workflow_id"), F.col("t.step_id").alias("step_id"), "need")


def examples(rows: DataFrame) -> DataFrame:
    """Triples of examples, told apart by their place, so that two of one name don't meet."""
    text = "xsd:string"
    found = rows.select("graph_id", "hash", F.col("s").alias("skill"), F.posexplode("examples").alias("n", "e")).withColumn("s", content_node("ex", "example", F.concat_ws(":", F.col("n").cast("string"), "e.name")))
    out = _link(found, "skill", "oc:hasExample", "s").union(_facts(found, ("rdf:type", F.lit("oc:Example"), "iri", None), ("oc:exampleName", F.col("e.name"), "literal", text), ("oc:inputDescription", F.col("e.input_description"), "literal", text), ("oc:outputExample", F.col("e.output_example"), "literal", text)))
    return out.union(_each(found, "oc:hasTag", F.col("e.tags"), "literal"))


# Of each list of content, its class, the relation to it, the prefix and kind of its nodes, and the predicates of content, kind and annotation.
FLAT = {
    "code_blocks": ("CodeExample", "hasCodeExample", "code", "code", "codeContent", "codeLanguage"),
    "tables": ("Table", "hasTable", "tab", "table", "tableMarkdown", "tableCaption"),
    "flowcharts": ("Flowchart", "hasFlowchart", "flow", "flow", "flowchartSource", "flowchartType"),
    "templates": ("Template", "hasTemplate", "tmpl", "tmpl", "templateContent", "templateVariables"),
    "procedures": ("Workflow", "hasWorkflow", "wf", "proc", None, None),
}
ANNOTATED = {"code_blocks": ("codePurpose", "codeContext"), "tables": ("tablePurpose",), "flowcharts": ("flowchartDescription",), "templates": ("templateType",)}
BLOCK_TYPES = {"code_blocks": "code_block", "tables": "table", "flowcharts": "flowchart", "templates": "template", "procedures": "ordered_procedure"}


def flat_triples(lists: DataFrame, documents: DataFrame, annotations: DataFrame | None = None, steps: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Triples of a document's typed lists, for documents without sections: never both.

    lists: rows of `markdown.flat_lists`; documents: (doc_id, hash, skill); annotations: (doc_id, list, idx, first, second), what is said of the list's block of that place;
    steps: (doc_id, block_id, position, text) of procedures; sections: (doc_id, ...) of documents that have a section tree.
    """
    text = "xsd:string"
    rows = lists.join(documents, "doc_id") if sections is None else lists.join(documents, "doc_id").join(sections.select("doc_id"), "doc_id", "left_anti")
    if annotations is not None:
        rows = rows.join(annotations.groupBy("doc_id", "list", "idx").agg(F.min(F.struct("first", "second")).alias("said")), ["doc_id", "list", "idx"], "left")
    rows = rows.withColumn("graph_id", F.col("doc_id").cast("string"))
    out = []
    for name, (kind, relation, prefix, part, content, told) in FLAT.items():
        apart = {"code_blocks": F.coalesce("language", F.lit("")), "tables": F.coalesce(F.nullif("caption", F.lit("")), F.lit("untitled")), "flowcharts": F.coalesce("language", F.lit("")), "templates": F.array_join("variables", ","), "procedures": None}[name]
        number = F.col("idx").cast("string")
        some = rows.where(F.col("list") == name).withColumn("s", content_node(prefix, part, number if apart is None else F.concat_ws(":", number, apart)))
        facts = [("rdf:type", F.lit(f"oc:{kind}"), "iri", None), ("oc:blockType", F.lit(BLOCK_TYPES[name]), "literal", text), ("oc:contentOrder", F.col("idx") + 1, "literal", "xsd:integer")]
        if content:
            facts.append((f"oc:{content}", F.col("content"), "literal", text))
        if name in ("code_blocks", "flowcharts"):
            facts.append((f"oc:{told}", F.coalesce("language", F.lit("")), "literal", text))
        if name == "code_blocks":
            facts.append(("oc:sourceLocation", F.concat(F.lit("lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")), "literal", text))
        if name == "tables":
            facts += [("oc:tableCaption", F.nullif("caption", F.lit("")), "literal", text), ("oc:rowCount", F.col("row_count"), "literal", "xsd:integer")]
        if name == "procedures":
            facts += [("oc:workflowId", F.concat(F.lit("procedure_"), number), "literal", text), ("oc:workflowName", F.lit("Ordered Procedure"), "literal", text)]
        if annotations is not None:
            facts += [(f"oc:{p}", F.col(f"said.{c}"), "literal", text) for p, c in zip(ANNOTATED.get(name, ()), ("first", "second"), strict=False)]
        out += [_link(some, "skill", f"oc:{relation}", "s"), _facts(some, *facts)]
        if name == "templates":
            out.append(_each(some, "oc:templateVariables", F.col("variables"), "literal"))
        if name == "procedures" and steps is not None:
            done = some.withColumnRenamed("s", "flow").select("doc_id", "graph_id", "hash", "idx", "flow", "block_id").join(steps, ["doc_id", "block_id"]).withColumn("s", content_node("step", "step", F.concat_ws("_", number, F.col("position").cast("string"))))
            out += [_link(done, "flow", "oc:hasStep", "s"), _facts(done, ("rdf:type", F.lit("oc:WorkflowStep"), "iri", None), ("oc:blockType", F.lit("workflow_step"), "literal", text), ("oc:stepId", F.concat(F.lit("step_"), F.col("position").cast("string")), "literal", text), ("dcterms:description", F.col("text"), "literal", text), ("oc:stepOrder", F.col("position"), "literal", "xsd:integer"))]
    made = reduce(DataFrame.unionByName, out)
    return distinct_triples(made.select("graph_id", "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang")))


def known_ids_text(skills: DataFrame) -> str:
    """A line `id: description`, of at most 120 characters of it, for each skill (id, description), sorted; a text for a request, so for as many skills as one can take."""
    rows = skills.select(F.concat(F.col("id"), F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, 120)).alias("line"), "id")
    return "\n".join(r.line for r in rows.orderBy("id").toLocalIterator())


# The class of each kind of block and where its content goes.
BLOCK_CLASSES = {"paragraph": ("Paragraph", "textContent"), "code_block": ("CodeExample", "codeContent"), "table": ("Table", "tableMarkdown"), "flowchart": ("Flowchart", "flowchartSource"), "template": ("Template", "templateContent"), "bullet_list": ("BulletList", None), "ordered_procedure": ("Workflow", None), "blockquote": ("BlockQuote", "quoteContent"), "html_block": ("HTMLBlock", "htmlContent"), "frontmatter": ("FrontmatterBlock", "rawYaml"), "bullet_item": ("BulletItem", "itemText"), "procedure_step": ("WorkflowStep", "dcterms:description")}
# How a block hangs on the one it is in, by that one's kind.
PART_OF = {"bullet_list": "oc:hasItem", "ordered_procedure": "oc:hasStep", "bullet_item": "oc:hasChild", "procedure_step": "oc:hasChild"}


def section_triples(sections: DataFrame, blocks: DataFrame, skill: Column) -> DataFrame:
    """Triples of section trees and their blocks, items and steps (see sources.markdown); `skill` names a document's skill node from doc_id.

    With a `section_id`, blocks hang on their sections, and procedures are workflows of the skill; items and steps hang on their lists and procedures, and what stands in them on them. Empty
    content is content too, null isn't. A block whose parent isn't among the blocks stays by itself.
    """
    section = lambda c: hashed_node("sec", 16, F.col("doc_id").cast("string"), F.lit("section"), F.col(c))
    block = lambda c: hashed_node("blk", 16, F.col("doc_id").cast("string"), F.lit("block"), F.col(c))
    graph, none = F.col("doc_id").cast("string").alias("graph_id"), F.lit(None).cast("string")
    s = sections.select(graph, "*", section("section_id").alias("s"))
    out = [_facts(s, ("rdf:type", F.lit("oc:Section"), "iri", None), ("oc:sectionTitle", F.col("title"), "literal", "xsd:string"), ("oc:sectionLevel", F.col("level"), "literal", "xsd:integer"), ("oc:sectionOrder", F.col("ord"), "literal", "xsd:integer"))]
    linked = lambda rows, s, p, o: rows.select("graph_id", s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"))
    top = F.col("parent_section_id").isNull()
    out.append(linked(sections.select(graph, "*"), F.when(top, skill).otherwise(section("parent_section_id")), F.when(top, F.lit("oc:hasSection")).otherwise(F.lit("oc:hasSubsection")), section("section_id")))
    kind = F.col("block_type")
    b = blocks.where(kind.isin(*BLOCK_CLASSES)).select(graph, "*", block("block_id").alias("s"))
    classes, fields, parts = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) for d in ({k: f"oc:{v[0]}" for k, v in BLOCK_CLASSES.items()}, {k: v[1] if ":" in v[1] else f"oc:{v[1]}" for k, v in BLOCK_CLASSES.items() if v[1]}, PART_OF))
    is_ = lambda *kinds: kind.isin(*kinds)
    inner = is_("bullet_item", "procedure_step")
    text, number = "xsd:string", "xsd:integer"
    out.append(_facts(
        b,
        ("rdf:type", classes[kind], "iri", None),
        ("oc:blockType", F.when(is_("procedure_step"), F.lit("workflow_step")).otherwise(kind), "literal", text),
        ("oc:contentOrder", F.when(~inner, F.col("content_order")), "literal", number),
        ("oc:codeLanguage", F.when(is_("code_block"), F.coalesce("language", F.lit(""))), "literal", text),
        ("oc:flowchartType", F.when(is_("flowchart"), F.col("language")), "literal", text),
        ("oc:sourceLocation", F.when(is_("code_block"), F.format_string("lines %d-%d", "line_start", "line_end")), "literal", text),
        ("oc:tableCaption", F.when(F.col("caption") != "", F.col("caption")), "literal", text),
        ("oc:rowCount", F.when(is_("table"), F.col("row_count")), "literal", number),
        ("oc:quoteAttribution", F.when(F.col("attribution") != "", F.col("attribution")), "literal", text),
        ("oc:itemOrder", F.when(is_("bullet_item"), F.col("position")), "literal", number),
        ("oc:stepOrder", F.when(is_("procedure_step"), F.col("position")), "literal", number),
        ("oc:stepId", F.when(is_("procedure_step"), F.concat(F.lit("step_"), F.col("position").cast("string"))), "literal", text),
        ("oc:workflowId", F.when(is_("ordered_procedure"), F.concat(F.lit("procedure_"), F.col("content_order").cast("string"))), "literal", text),
        ("oc:workflowName", F.when(is_("ordered_procedure"), F.lit("Ordered Procedure")), "literal", text),
    ))
    said = b.where(fields[kind].isNotNull() & F.col("content").isNotNull())
    out.append(said.select("graph_id", "s", fields[kind].alias("p"), F.col("content").alias("o"), F.lit("literal").alias("o_kind"), F.lit(text).alias("o_dt")))
    out.append(_each(b.where(is_("template")), "oc:templateVariables", F.col("variables"), "literal"))
    lists = blocks.select("doc_id", F.col("block_id").alias("parent_block_id"), F.col("block_type").alias("parent_type"))
    held = b.where("parent_block_id is not null").join(lists, ["doc_id", "parent_block_id"]).where(parts[F.col("parent_type")].isNotNull())
    out.append(linked(held, block("parent_block_id"), parts[F.col("parent_type")], F.col("s")))
    if "section_id" in blocks.columns:
        tops = b.where("parent_block_id is null")
        out.append(linked(tops, section("section_id"), F.lit("oc:hasContent"), F.col("s")))
        out.append(linked(tops.where(is_("ordered_procedure")), skill, F.lit("oc:hasWorkflow"), F.col("s")))
    rows = reduce(DataFrame.unionByName, out)
    return distinct_triples(rows.select("graph_id", "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_dt", F.lit(None).cast("string").alias("o_lang")))


def enrich(records: DataFrame, paths: DataFrame, known: DataFrame) -> DataFrame:
    """Records with the skill of the nearest directory above as one they extend, and relations to known skills only.

    paths: (id, path); known: (id). What is extended isn't also depended on, and a skill isn't related to itself. A parent is found by equality
    of directories: each path is joined by its ancestors, of which there are few.
    """
    parts = F.split("path", "/")
    above = paths.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("above")).where("above <> ''")
    parents = above.join(paths.select(F.col("path").alias("above"), F.col("id").alias("parent")), "above").where("parent <> id").groupBy("id").agg(F.max_by("parent", F.length("above")).alias("parent"))
    ids = known.select(F.col("id").alias("other")).distinct()
    every = [records.select("id", F.lit(c).alias("relation"), F.posexplode(F.coalesce(F.col(c), F.array().cast(LIST))).alias("n", "other")) for c in ("extends", "depends_on", "contradicts")]
    # relations are rows while they are looked up, so known ids meet them in one semi-join
    kept = reduce(DataFrame.union, every).where("other <> id").join(ids, "other", "left_semi")
    lists = kept.groupBy("id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == c, F.struct("n", "other")))), lambda x: x["other"]).alias(f"_{c}") for c in ("extends", "depends_on", "contradicts")])
    rows = records.join(parents, "id", "left").join(lists, "id", "left")
    some = lambda c: F.coalesce(F.col(f"_{c}"), F.array().cast(LIST))
    extends = F.array_distinct(F.concat(some("extends"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast(LIST))))
    rows = rows.withColumn("extends", extends).withColumn("contradicts", some("contradicts"))
    return rows.withColumn("depends_on", F.array_except(some("depends_on"), "extends")).select(records.columns)


# What states and the segments of a relation look like.
STATE = "^oc:[A-Z][a-zA-Z0-9]*(:[a-zA-Z0-9_-]+)?$"
SEGMENT = "^[a-z0-9]+(-[a-z0-9]+)*$"
RELATIONS = ("depends_on", "extends", "contradicts")


def valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be serialised, cleaned, and those that can't, with the reason: `id`, `state` or `relation`.

    A relation is an address, an `oc:` term, or segments of small letters, digits and hyphens, of which the last stays; spaces around it go. Knowledge without a type or directive is
    dropped. `is_user_invocable` as text is true for true, yes and 1 in any case of letters. A null list or state is none; an empty relation is wrong.
    """
    every = lambda c, test: F.forall(F.coalesce(F.col(c), F.array().cast(LIST)), lambda x: F.coalesce(test(x), F.lit(False)))
    states = lambda c: every(c, lambda x: x.rlike(STATE))
    address = lambda x: F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://")) | F.startswith(x, F.lit("oc:"))
    related = lambda c: every(c, lambda x: (F.trim(x) != "") & (address(F.trim(x)) | F.forall(F.split(F.trim(x), "/"), lambda part: part.rlike(SEGMENT))))
    reason = F.when(F.col("id").isNull() | ~F.col("id").rlike("^[A-Za-z0-9._/-]{1,64}$"), "id").when(~states("requires_state") | ~states("yields_state") | ~states("handles_failure"), "state")
    for c in RELATIONS:
        reason = reason.when(~related(c), "relation")
    rows = records.withColumn("reason", reason)
    last = lambda c: F.transform(F.col(c), lambda x: F.when(address(F.trim(x)), F.trim(x)).otherwise(F.substring_index(F.trim(x), "/", -1))).alias(c)
    clean = rows.where("reason is null").drop("reason").withColumns({c: last(c) for c in RELATIONS})
    if dict(clean.dtypes).get("is_user_invocable") == "string":
        clean = clean.withColumn("is_user_invocable", F.lower("is_user_invocable").isin("true", "yes", "1"))
    return clean.withColumn("knowledge", F.filter("knowledge", lambda k: k["node_type"].isNotNull() & k["directive"].isNotNull())), rows.where("reason is not null")


class InvalidModules(ValueError):
    """Modules that shapes refuse, with the first of their violations."""


def modules(records: DataFrame, content: DataFrame | None = None, core: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, rejected): the modules of records, a graph each, ready to be written, and the records that `valid` rejects with the reason.

    content: more triples of the modules, of sections and blocks (see `section_triples`). A module has the links that its own nodes and sections imply, and imports `core` if that is given.
    """
    good, bad = valid(records)
    t = skill_triples(good)
    if content is not None:
        t = t.unionByName(content.join(good.select(F.col("id").alias("graph_id")), "graph_id", "left_semi"))
    t, none = stored(t), F.lit(None).cast("string")
    home = t.select("s", "graph_id").groupBy("s").agg(F.min("graph_id").alias("graph_id"))
    linked = infer_links(t).join(home, "s").select("graph_id", "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    t = t.unionByName(linked)
    if core:
        t = t.unionByName(t.select("graph_id").distinct().select("graph_id", F.lit(BASE.rstrip("#")).alias("s"), F.lit("iri").alias("s_kind"), F.lit("owl:imports").alias("p"), F.lit(core).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang")))
    return distinct_triples(t), bad


def publish(records: DataFrame, path: str, content: DataFrame | None = None, core: str | None = None) -> DataFrame:
    """Write the modules of records as Turtle, a folder each; the records that were rejected, with the reason.

    Nothing is written if the vocabulary's shapes find anything worse than a warning: that is an error (InvalidModules) with the first violations.
    """
    from graphwright.operators import shapes
    from graphwright.operators.catalog import class_tree
    from graphwright.sources.turtle import write_turtle

    t, bad = modules(records, content, core)
    t = stored(t)
    found = shapes.validate(t, class_tree(), shapes.read(shapes.vocabulary(t.sparkSession))).where("severity = 'Violation'")
    first = found.orderBy("focus", "path", "kind").limit(5).collect()
    if first:
        raise InvalidModules("; ".join(f"{r.focus} {r.path}: {r.kind} {r.value}" for r in first))
    write_turtle(t, path, BASE)
    drop(t)
    return bad


def merge(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """The old graph with the new one's skills in place of theirs. A skill with the same content hash stays unless forced; what goes with a skill
    goes too: all triples of its graph."""
    if not force:
        hashes = lambda t: t.where("p = 'oc:contentHash'").select("graph_id", "o")
        new = new.join(hashes(new).join(hashes(old), ["graph_id", "o"], "left_semi").select("graph_id"), "graph_id", "left_anti")
    return old.join(new.select("graph_id").distinct(), "graph_id", "left_anti").unionByName(new)


def orphans(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Output paths (output, source) whose source is gone."""
    return outputs.join(sources, "source", "left_anti")


def content_hash(files: DataFrame) -> DataFrame:
    """(directory, hash) of files (directory, path, content binary): the SHA-256 over paths and contents' hashes in order of paths."""
    parts = files.select("directory", "path", F.sha2("content", 256).alias("h")).groupBy("directory").agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("x"))
    frame = lambda x: F.concat(F.lpad(F.octet_length(x).cast("string"), 4, "0"), x)
    return parts.select("directory", F.sha2(F.array_join(F.transform("x", lambda f: F.concat(frame(f["path"]), frame(f["h"]))), ""), 256).alias("hash"))
