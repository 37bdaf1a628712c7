"""Cases of registries, records, links, folders and nested lists that were wrong once."""

import os

from graphwright.operators import links, registry, serialise
from graphwright.operators.triples import SCHEMA
from graphwright.sources import files, markdown, turtle
from graphwright.sources import star_graph as sg

PREFIX = "@prefix oc: <http://example.org/ontology#> .\n"
LOCK = "package_id string, skill_id string, trust_tier string, enabled boolean"


def graph(spark, text):
    return spark.createDataFrame([("g", *r) for r in turtle.parse(PREFIX + text)], SCHEMA)


def on(df):
    return {(r.package_id, r.skill_id) for r in df.collect() if r.enabled}


def test_enabling_prefers_the_package_asked_for(spark):
    lock = spark.createDataFrame([("mine", "x", "community", False), ("other", "x", "official", False), ("mine", "y", "community", False), ("other", "y", "official", False), ("other", "z", "official", False), ("last", "z", "verified", False)], LOCK)
    needs = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "gone"), ("z", "x")], "skill_id string, needs string")
    asked = lambda *rows: spark.createDataFrame(rows, "package_id string, skill_id string")
    assert on(registry.enable(lock, needs, asked(("mine", "x")))) == {("mine", "x"), ("mine", "y"), ("other", "z")}
    assert on(registry.enable(lock, needs, asked((None, "x")))) == {("other", "x"), ("other", "y"), ("other", "z")}
    assert on(registry.enable(lock, needs, asked(("mine", None)))) == {("mine", "x"), ("mine", "y"), ("other", "z")}
    assert on(registry.enable(lock, needs, asked(("unknown", "y"), ("mine", "no such")))) == {("other", "x"), ("other", "y"), ("other", "z")}
    # what a skill needs may differ by package
    own = spark.createDataFrame([("mine", "x", "z"), ("other", "x", "y")], "package_id string, skill_id string, needs string")
    assert on(registry.enable(lock, own, asked(("mine", "x")))) == {("mine", "x"), ("other", "z")}
    assert on(registry.enable(lock.limit(0), needs, asked(("mine", "x")))) == set() == on(registry.enable(lock, needs, asked(("mine", "x")).limit(0)))


def test_disabling_goes_through_enabled_skills(spark):
    lock = spark.createDataFrame([("mine", "x", "local", True), ("other", "x", "local", True), ("other", "y", "local", False), ("mine", "w", "local", True), ("other", "v", "local", True), ("mine", "n", "local", None)], LOCK)
    needs = spark.createDataFrame([("y", "x"), ("w", "y"), ("v", "x")], "skill_id string, needs string")
    gone = spark.createDataFrame([("mine", "x")], "package_id string, skill_id string")
    # y is off already, so w, which needs it, stays; v of another package needs x by its id
    assert on(registry.disable(lock, needs, gone)) == {("other", "x"), ("mine", "w")}
    assert on(registry.disable(lock, needs, gone.select("skill_id"))) == {("mine", "w")}
    assert on(registry.disable(lock, needs, gone.limit(0))) == {("mine", "x"), ("other", "x"), ("mine", "w"), ("other", "v")}


def test_skills_by_the_short_name_of_their_package(spark):
    packages = spark.createDataFrame([("pbakaus/impeccable",), ("a/two",), ("b/two",), ("one",), ("x/one/deep",)], "package_id string")
    skills = spark.createDataFrame([("pbakaus/impeccable", "harden"), ("a/two", "s"), ("one", "deep/s")], "package_id string, skill_id string")
    refs = spark.createDataFrame([("impeccable/harden",), ("pbakaus/impeccable/harden",), ("impeccable/none",), ("two/s",), ("a/two/s",), ("one/deep/s",), (None,)], "ref string")
    want = {("impeccable/harden", "pbakaus/impeccable"), ("pbakaus/impeccable/harden", "pbakaus/impeccable"), ("a/two/s", "a/two"), ("one/deep/s", "one")}
    assert {(r.ref, r.package_id) for r in registry.resolve_packages(refs, packages, skills).where("level = 4").collect()} == want
    assert ("impeccable/none", "pbakaus/impeccable") in {(r.ref, r.package_id) for r in registry.resolve_packages(refs, packages).collect()}


def test_states_and_relations_of_records(spark):
    rows = sg.records(spark.read.parquet("/root/testdata/sf0.001/part.parquet")).limit(1)
    from pyspark.sql import functions as F

    def verdict(**columns):
        good, bad = serialise.valid(rows.withColumn("yields_state", F.array().cast("array<string>")).withColumn("contradicts", F.array().cast("array<string>")).withColumns({k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for k, v in columns.items()}))
        return bad.first().reason if bad.count() else good.first()

    for state in ("lowercase", "oc:bad/State#x", "oc:lower", "http://x.org/State", "oc:Good:", "oc:Go-od", ""):
        assert verdict(requires_state=[state]) == "state", state
    for relation in ("Not Valid!", "", " ", "a//b", "Upper", "a-", "a/Upper"):
        for column in ("depends_on", "extends", "contradicts"):
            assert verdict(**{column: [relation]}) == "relation", relation
    good = verdict(requires_state=["oc:Good", "oc:Good:with_a-9"], extends=["author/package/office", " docx-review ", "oc:skill_x", "https://x.org/a"], is_user_invocable="Yes")
    assert good.extends == ["office", "docx-review", "oc:skill_x", "https://x.org/a"] and good.is_user_invocable is True and verdict(is_user_invocable="no").is_user_invocable is False


def test_links_to_subsections_and_links_that_are_there(spark):
    t = graph(spark, """oc:S oc:hasSection oc:s1 ; oc:impartsKnowledge oc:k, oc:m . oc:s1 oc:sectionTitle "Top" ; oc:hasSubsection oc:s2, oc:s3 . oc:s2 oc:sectionTitle "Error Handling" ; oc:hasSubsection oc:s4 . oc:s3 oc:sectionTitle "The right way" . oc:s4 oc:sectionTitle "retry with backoff" .
oc:k a oc:AntiPattern ; oc:appliesToContext "error handling rules" . oc:m oc:appliesToContext "always retry with a backoff" .""")
    assert {(r.s, r.o) for r in links.derived_from_section(t).collect()} == {("oc:k", "oc:s2"), ("oc:m", "oc:s4")}
    assert {(r.s, r.p, r.o) for r in links.infer_links(t).where("p = 'oc:correctAlternative'").collect()} == {("oc:k", "oc:correctAlternative", "oc:s3")}
    assert links.infer_links(t.union(graph(spark, "oc:k oc:correctAlternative oc:other ."))).where("p = 'oc:correctAlternative'").count() == 0


def test_files_that_a_scan_leaves_out(spark, tmp_path):
    for name in ("SKILL.md", "a.TS", "b.yaml", "c.tar.gz", "noending", "target/x.md", "deep/target/y.md", "target.md", ".hidden/x.md", "d/.h", "back\\slash.md", "e.docx", "f.svg", "notes..md"):
        os.makedirs(os.path.dirname(tmp_path / name) or tmp_path, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r.relative: r.mime for r in files.directory(spark, str(tmp_path)).collect()}
    assert found == {"SKILL.md": "text/markdown", "a.TS": "text/typescript", "b.yaml": "application/x-yaml", "c.tar.gz": "application/octet-stream", "noending": "application/octet-stream", "target.md": "text/markdown", "e.docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "f.svg": "image/svg+xml", "notes..md": "text/markdown"}
    assert len(files.MIME) == 27


def test_lists_within_lists_at_any_depth():
    deep = markdown.parse("\n".join("  " * i + f"- level {i}" for i in range(200)))
    items = [b for b in deep if b.block_type == "bullet_item"]
    assert [b.content for b in items] == [f"level {i}" for i in range(200)] and len({b.block_id for b in deep}) == 400 and items[-1].line_start == 200 and max(len(b.block_id) for b in deep) < 450
    mixed = markdown.parse("1. a\n   - b\n     1. c\n\n2. d")
    assert [(b.block_type, b.content) for b in mixed if b.position] == [("procedure_step", "a"), ("bullet_item", "b"), ("procedure_step", "c"), ("procedure_step", "d")]


CONTENT = "intro\n\n# Top\n- a\n  > q\n  > — Me\n- b\n\n1. one\n   ```py\n   x\n   ```\n2. two\n\nT:\n| a |\n|---|\n| 1 |\n\n```mermaid\ng\n```\n\n```\nHi {name} {name} {b}\n```\n\n<div>x</div>\n"


def test_content_nodes_as_they_are_read_again(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, CONTENT), (2, None), (3, "```\nx\n```")], "doc_id int, text string")
    found = markdown.blocks(docs)
    inside = markdown.in_sections(found)
    placed = inside.unionByName(found.where("parent_block_id is not null").withColumn("section_id", F.lit(None).cast("string")))
    t = serialise.section_triples(markdown.sections(found), placed, F.concat(F.lit("oc:skill_"), F.col("doc_id").cast("string")))
    facts = {}
    for r in t.where("graph_id = '1'").collect():
        facts.setdefault(r.s, {}).setdefault(r.p, []).append(r.o)
    kind = lambda name: [n for n, f in facts.items() if f.get("oc:blockType") == [name]]
    say = lambda n, *ps: [facts[n].get(f"oc:{p}") for p in ps]
    (bullets,), (steps,), (quote,), (code,), (table,), (chart,), (template,), (html,) = map(kind, ("bullet_list", "ordered_procedure", "blockquote", "code_block", "table", "flowchart", "template", "html_block"))
    assert facts["oc:skill_1"]["oc:hasWorkflow"] == [steps] and say(steps, "workflowName", "workflowId") == [["Ordered Procedure"], ["procedure_2"]] and "oc:textContent" not in facts[bullets]
    items = {facts[n]["oc:itemOrder"][0]: n for n in facts[bullets]["oc:hasItem"]}
    assert {k: facts[n]["oc:itemText"] for k, n in items.items()} == {"1": ["a"], "2": ["b"]} and facts[items["1"]]["oc:hasChild"] == [quote] and say(quote, "quoteContent", "quoteAttribution") == [["q"], ["Me"]]
    done = {facts[n]["oc:stepOrder"][0]: n for n in facts[steps]["oc:hasStep"]}
    assert {k: (facts[n]["oc:stepId"], facts[n]["dcterms:description"], facts[n]["oc:blockType"]) for k, n in done.items()} == {"1": (["step_1"], ["one"], ["workflow_step"]), "2": (["step_2"], ["two"], ["workflow_step"])}
    assert facts[done["1"]]["oc:hasChild"] == [code] and say(code, "codeLanguage", "codeContent", "sourceLocation") == [["py"], ["x"], ["lines 10-12"]]
    assert say(table, "tableCaption", "rowCount", "contentOrder") == [["T"], ["1"], ["4"]]
    assert say(chart, "flowchartType", "codeLanguage", "flowchartSource") == [["mermaid"], None, ["g"]] and sorted(facts[template]["oc:templateVariables"]) == ["b", "name"] and say(html, "htmlContent") == [["<div>x</div>"]]
    # a code block without a language has an empty one
    assert t.where("graph_id = '3' and p = 'oc:codeLanguage'").first().o == "" and t.where("graph_id = '2'").isEmpty()


def test_names_relations_and_facets(spark):
    from graphwright.operators import catalog

    t = graph(spark, """@prefix dcterms: <http://purl.org/dc/terms/> . oc:skill_a a oc:Skill ; dcterms:identifier "a-skill" ; oc:resolvesIntent "x" ; oc:extends oc:skill_b, oc:skill_no_id ; oc:dependsOn oc:skill_b, oc:State, "oc:skill_text" . oc:skill_b a oc:Skill ; dcterms:identifier "b" ; oc:dependsOnSkill oc:skill_a .
    oc:createpdf oc:resolvesIntent "y" . oc:skill_c a oc:Skill ; oc:extends oc:skill_a .""")
    assert {(r.skill_id, r.needs) for r in registry.skill_relations(t).collect()} == {("a-skill", "b"), ("a-skill", "no-id"), ("b", "a-skill")}
    names = spark.createDataFrame([("a-skill",), ("skill_a",), ("Create-PDF",), ("create_pdf",), ("skill_b",), ("gone",), (None,)], "n string")
    assert {r.name: r.uri for r in catalog.find_named(t, names).collect()} == {"a-skill": "oc:skill_a", "skill_a": "oc:skill_a", "Create-PDF": "oc:createpdf", "create_pdf": "oc:createpdf"}
    skill = "skills array<struct<id:string,category:string,intents:array<string>>>"
    packages = spark.createDataFrame([("me/p", "local", [("i", "c", ["Find it"]), ("j", None, None)]), ("you", None, [("k", "", [])])], f"package_id string, trust_tier string, {skill}")
    assert {tuple(r) for r in catalog.facet_values(packages).collect()} == {("author", "me", 2), ("author", "you", 1), ("category", "c", 1), ("tier", "local", 2)}
    assert [r.id for r in catalog.facets(packages, author="me", text="find").collect()] == ["i"] and [r.id for r in catalog.facets(packages, author="p").collect()] == []


def test_modules_are_checked_before_they_are_written(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    rows = sg.records(spark.read.parquet("/root/testdata/sf0.001/part.parquet")).where("id in ('part-4', 'part-5', 'part-6', 'part-8')")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"yields_state": none, "contradicts": none, "depends_on": none, "extends": F.when(F.col("id") == "part-6", F.array(F.lit("Not Valid"))).otherwise(none), "package": F.lit(None).cast("string")})
    core = "http://example.org/core.ttl"
    bad = serialise.publish(rows, str(tmp_path / "out"), core=core)
    assert [(r.id, r.reason) for r in bad.collect()] == [("part-6", "relation")]
    back = turtle.read_turtle(spark, str(tmp_path / "out"))
    skills = {r.o for r in back.where("p = 'dcterms:identifier'").collect()}
    assert skills == {"part-4", "part-5", "part-8"} and {r.o for r in back.where("p = 'owl:imports'").collect()} == {core} and back.where("p = 'owl:imports'").count() == 3
    # a second step of order 1 in one module doesn't make the other's ambiguous
    told = rows.withColumn("knowledge", F.transform("knowledge", lambda k: k.withField("context", F.lit("see step 0"))))
    steps = spark.createDataFrame([("part-4", "oc:st4", "0"), ("part-5", "oc:st5", "0"), ("part-5", "oc:st5b", "0")], "graph_id string, s string, n string")
    fact = lambda p, o, kind: steps.select("graph_id", "s", F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    t, _ = serialise.modules(told, fact("rdf:type", F.lit("oc:WorkflowStep"), "iri").union(fact("oc:stepOrder", F.col("n"), "literal")))
    # a procedure's step of the record itself may have the order 0 too; links go to steps of the own module only
    links_ = {(r.graph_id, r.o) for r in t.where("p = 'oc:appliesToStep'").collect()}
    assert ("part-4", "oc:st4") in links_ and not {o for g, o in links_ if g == "part-5"} & {"oc:st4", "oc:st5", "oc:st5b"}
    # no intent, no module at all
    with pytest.raises(serialise.InvalidModules, match="resolvesIntent"):
        serialise.publish(rows.withColumn("intents", F.when(F.col("id") != "part-4", F.col("intents"))), str(tmp_path / "never"), core=core)
    assert not os.path.exists(tmp_path / "never")
