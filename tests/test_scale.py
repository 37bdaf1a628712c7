"""Work that stays in proportion to the input: each case did more before than its result asks for."""

from pyspark.sql import functions as F

from graphwright.llm import lexical
from graphwright.operators import closure, graphs, links, lint, nearest, reason, render, serialise
from graphwright.operators.triples import SCHEMA
from graphwright.queries import content, graph  # noqa: F401
from graphwright.queries.graph import table
from graphwright.sources import scratch, star_graph


def triples(spark, rows):
    return spark.createDataFrame([("g", s, "iri", p, o, "iri" if o.startswith("oc:") else "literal", None, None) for s, p, o in rows], SCHEMA)


def test_steps_by_labels_of_one_beginning(spark):
    n = 300
    rows = [x for i in range(n) for x in ((f"oc:s{i}", "rdf:type", "oc:WorkflowStep"), (f"oc:s{i}", "oc:stepLabel", f"Label {i};"), ("oc:k", "oc:impartsKnowledge", f"oc:n{i}"), (f"oc:n{i}", "oc:appliesToContext", f"in LABEL {i}; then"))]
    rows += [("oc:k", "oc:impartsKnowledge", "oc:two"), ("oc:two", "oc:appliesToContext", "label 1; and label 2;"), ("oc:s7", "oc:stepLabel", "x"), ("oc:k", "oc:impartsKnowledge", "oc:x"), ("oc:x", "oc:appliesToContext", "X, label 7;")]
    found = links.applies_to_step(triples(spark, rows))
    assert {tuple(r) for r in found.collect()} == {(f"oc:n{i}", "oc:appliesToStep", f"oc:s{i}") for i in range(n)} | {("oc:x", "oc:appliesToStep", "oc:s7")}
    # labels are joined whole, not by letters that all of them share
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_one_hop_makes_no_edges_of_other_states(spark, tmp_path):
    rows = [(s, p, o) for i in range(60) for s, p, o in ((f"oc:far{i}", "oc:yieldsState", "oc:Far"), (f"oc:far{i}", "oc:requiresState", "oc:Far"))]
    rows += [("oc:a", "oc:yieldsState", "oc:X"), ("oc:b", "oc:requiresState", "oc:X"), ("oc:b", "oc:yieldsState", "oc:Y"), ("oc:c", "oc:requiresState", "oc:Y"), ("oc:d", "oc:yieldsState", "oc:X"), ("oc:c", "oc:yieldsState", "oc:Far")]
    t = triples(spark, rows)
    for node in ("oc:a", "oc:b", "oc:far1", "oc:none"):
        whole = graphs.one_hop(graphs.state_edges(t), node).select("producer", "consumer", "state")
        assert sorted(map(tuple, graphs.states_around(t, node).collect())) == sorted(map(tuple, whole.collect()))
    made = graphs.states_around(t, "oc:a")._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Join Inner") == 1


def test_phrases_of_a_person_in_one_pass(spark):
    texts = ["I'm", "i'll, MY", "Your, you can", "im", "I_m my2 wE'd", "mine me", "éme me", None, "You  can", "x I've x", "𝐀me", "You should\nour"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = lint.third_person(docs)
    slow = docs.select(F.col("doc_id").cast("string").alias("i"), F.array_join(F.array_compact(F.array(*[F.when(F.col("text").rlike(lint.person_pattern(p)), F.lit(p)) for p in lint.PERSON])), ",").alias("f")).where("f <> ''")
    assert sorted((r.skill_id, r.detail) for r in found.collect()) == sorted(map(tuple, slow.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rlike") <= 1 < len(lint.PERSON)


def test_one_long_row_group_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 100)
    part = spark.range(1000).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#7").alias("p_brand"), F.lit("PROMO").alias("p_type"), F.lit(4).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for rows in (star_graph.content_graph(spark, str(tmp_path)), table(spark, str(tmp_path), "part")):
        assert rows.rdd.getNumPartitions() == 10
    assert table(spark, str(tmp_path), "part").count() == 1000


def test_broadcasts_go_by_measured_sizes(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    own = graph.QUERIES["kn_links"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in own._jdf.queryExecution().sparkPlan().toString()
    assert own.sparkSession.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == limit
    assert own.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    # the caller's session stays as it was
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit != "-1"


def test_index_is_stored_in_files_of_few_blocks(spark, monkeypatch):
    import pyarrow.dataset as ds

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200_000).alias("text")).coalesce(1)
    sizes = []
    search = lexical.search
    monkeypatch.setattr(lexical, "search", lambda blocks, *a: (sizes.extend(ds.dataset(f).count_rows() for f in (x.removeprefix("file:") for x in blocks.inputFiles())), search(blocks, *a))[1])
    found = lexical.rank(docs, spark.createDataFrame([(1, "words")], "item_id int, text string"), 3)
    assert [r.id for r in found.orderBy("rank").collect()] == [0, 1, 2]
    assert sum(sizes) == 20 and max(sizes) <= lexical.TOGETHER


def _kept(monkeypatch, look):
    """Has `look` see each table that a closure stores, before it is written."""
    write = closure.stored
    monkeypatch.setattr(closure, "stored", lambda df, *a, **b: (look(df), write(df, *a, **b))[1])


def test_a_closure_makes_each_pair_of_a_chain_once(spark, monkeypatch):
    edges, made = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "src string, dst string"), []
    join = type(edges).join
    monkeypatch.setattr(type(edges), "join", lambda self, other, on=None, how=None: (out := join(self, other, on, how), made.append(out.count()) if on == "dst" else None)[0])
    assert closure.closure(edges).count() == 20 * 21 // 2 and sum(made) == 20 * 21 // 2 - 20
    assert closure.closure(edges, most=2).count() == 20 + 19 + 18


def test_rounds_of_a_search_for_cycles_are_not_broadcast(spark, monkeypatch):
    plans = []
    _kept(monkeypatch, lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()))
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a")]
    found = closure.shortest_cycles(spark.createDataFrame(edges, "src string, dst string"))
    assert {tuple(r) for r in found.collect()} == {("a", 0, "a"), ("a", 1, "b"), ("a", 2, "a"), ("c", 0, "c"), ("c", 1, "d"), ("c", 2, "e"), ("c", 3, "c")}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_contexts_of_many_skills_are_one_batch(spark):
    skills = spark.createDataFrame([(f"s{i}", f"i{i}", ["x"]) for i in range(30)], "uri string, id string, intents array<string>")
    nodes = spark.createDataFrame([(f"s{i}", f"n{j}", "rule", f"do {j}", None) for i in range(0, 40, 2) for j in range(i % 3)], "uri string, node string, kind string, directive_content string, step_order long")
    found = render.contexts(skills, nodes)
    want = {f"s{i}": f"## i{i}\nIntents: x" + ("\n\n" + "\n".join(f"  RULE:\n  do {j}" for j in range(i % 3)) if i % 2 == 0 and i % 3 else "") for i in range(30)}
    assert {r.uri: r.text for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan


def test_edges_of_a_state_of_many_are_dealt_by_their_number(spark, monkeypatch):
    rows = [x for i in range(40) for x in ((f"oc:n{i}", "oc:yieldsState", "oc:Many"), (f"oc:n{i}", "oc:requiresState", "oc:Many"))]
    rows += [("oc:n1", "oc:yieldsState", "oc:One"), ("oc:n2", "oc:requiresState", "oc:One"), ("oc:n2", "oc:requiresState", "oc:One"), ("oc:n3", "oc:yieldsState", "oc:None")]
    monkeypatch.setattr(graphs, "SHARE", 8)
    monkeypatch.setattr(graphs, "EDGES", 100)
    found = graphs.state_edges(triples(spark, rows))
    assert sorted(map(tuple, found.collect())) == sorted([(f"oc:n{a}", f"oc:n{b}", "oc:Many") for a in range(40) for b in range(40)] + [("oc:n1", "oc:n2", "oc:One")])
    sizes = [n for n in found.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert found.rdd.getNumPartitions() == 17 and len(sizes) > 5 and max(sizes) < 800
    # names are cut before there is a row for each pair
    plan = graph.QUERIES["graph_state_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.split("Join Inner")[0]
    assert graphs.state_edges(triples(spark, rows[:0])).collect() == []


def test_a_full_share_of_vectors_is_compared_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(3), nearest.SHARE
    side = lambda m: pa.table({"id": pa.array(np.arange(m)), "v": pa.array(list(rng.normal(size=(m, 16))))})
    left, right = side(n), side(500)
    tracemalloc.start()
    found = nearest._compared(3)(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 < 250 * n * 8 * 2
    at, asked = (np.stack(t.column("v").to_numpy()) for t in (left, right))
    scores = (asked[:20] / np.linalg.norm(asked[:20], axis=1, keepdims=True)) @ (at / np.linalg.norm(at, axis=1, keepdims=True)).T
    scores[np.arange(20), np.arange(20)] = -1
    assert found.num_rows == 1500 and found.column("id").to_numpy()[:60].tolist() == np.argsort(-scores, axis=1)[:, :3].ravel().tolist()


def test_triples_of_records_are_made_distinct_by_tasks_in_number(spark, monkeypatch):
    records = star_graph.records(table(spark, "/root/testdata/sf0.001", "part").where("p_partkey < 60"))
    whole = sorted(map(str, serialise.skill_triples(records).collect()))
    monkeypatch.setattr(serialise, "RECORDS", 10)
    dealt = serialise.skill_triples(records.union(records))
    assert sorted(map(str, dealt.collect())) == whole
    rows = dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert dealt.rdd.getNumPartitions() == 12 and len(rows) == 12 and rows.max() < len(whole) / 6


def test_alternatives_read_the_graph_once_and_pair_no_siblings(spark, monkeypatch):
    n = 40
    rows = [x for i in range(n) for x in (("oc:p", "oc:hasSubsection", f"oc:s{i:02}"), (f"oc:s{i:02}", "oc:sectionTitle", "what you SHOULD do"), (f"oc:a{i}", "rdf:type", "oc:AntiPattern"), (f"oc:a{i}", "oc:derivedFromSection", f"oc:s{i:02}"), ("oc:s00", "oc:hasContent", f"oc:b{i}"), (f"oc:b{i}", "rdf:type", "oc:CodeExample"))]
    # one of two parents has a sibling that tells it; the other parent's only one is the section itself
    rows += [("oc:q", "oc:hasSection", "oc:x"), ("oc:r", "oc:hasSection", "oc:x"), ("oc:r", "oc:hasSubsection", "oc:y"), ("oc:r", "oc:hasSubsection", "oc:y"), ("oc:y", "oc:sectionTitle", "instead"), ("oc:x", "oc:sectionTitle", "proper"), ("oc:n", "rdf:type", "oc:AntiPattern"), ("oc:n", "oc:derivedFromSection", "oc:x")]
    rows += [("oc:s01", "oc:hasContent", "oc:b1"), ("oc:had", "rdf:type", "oc:AntiPattern"), ("oc:had", "oc:derivedFromSection", "oc:x"), ("oc:had", "oc:correctAlternative", "oc:z"), ("oc:m", "oc:derivedFromSection", "oc:x")]
    made, join = [], type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how=None: (out := join(self, other, on, how), made.append(out.count()))[0])
    found = links.correct_alternative(triples(spark, rows))
    assert {tuple(r) for r in found.collect()} == {("oc:n", "oc:correctAlternative", "oc:y"), ("oc:a1", "oc:correctAlternative", "oc:b1")}
    assert max(made) <= 3 * n + 10
    assert "Generate" not in graph.QUERIES["link_alternatives"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_facts_of_named_predicates_are_those_of_the_whole_graph(spark):
    whole, some = star_graph.content_graph(spark, "/root/testdata/sf0.001"), ("oc:hasContent", "oc:timeout", "rdf:type")
    few = star_graph.content_graph(spark, "/root/testdata/sf0.001", *some)
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.where(F.col("p").isin(*some)).collect()))
    assert "oc:directiveContent" not in few._jdf.queryExecution().optimizedPlan().toString()
