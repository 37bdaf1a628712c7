"""Searches for many queries at once, by cells of vectors and by blocks of postings, and the cut-off over all scores."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.operators import impacts, nearest, search
from graphwright.queries import graph
from graphwright.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def test_indexed_neighbours_are_nearly_all(spark):
    exact = {(r.query, r.id) for r in graph.QUERIES["vec_neighbours_exact"](spark, SF).collect()}
    found = graph.QUERIES["vec_neighbours"](spark, SF).collect()
    assert len(found) == len(exact) and len({(r.query, r.id) for r in found} & exact) >= 0.9 * len(exact)


def brute_neighbours(rows, queries, k):
    unit = {i: np.array(v, float) / (np.linalg.norm(v) or 1) for i, v in rows}
    out = set()
    for q in queries:
        near = sorted((-round(float(unit[q] @ v), 9) + 0.0, i) for i, v in unit.items() if i != q)[:k]
        out |= {(q, n, i) for n, (_, i) in enumerate(near, 1)}
    return out


def test_neighbours_in_shares(spark, monkeypatch):
    """One cell with most vectors, equal vectors among them, dealt over shares; every row filed."""
    monkeypatch.setattr(nearest, "SHARE", 7)
    monkeypatch.setattr(nearest, "BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (1, 0, 0)] if i % 3 == 0 else [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(60)]
    bad = [(100, None), (101, [1.0]), (102, [1.0, None, 0.0]), (103, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, cell string, share int")
    centres = nearest.fit_cells(table, 4)
    filed = stored(nearest.file_vectors(table, centres))
    assert {r.id for r in filed.select("id").collect()} == {i for i, _ in rows} | {None} and filed.agg(F.max("share")).first()[0] > 1
    asked = table.where("vec_id % 20 = 0 or vec_id > 99")
    got = {(r.query, r.rank, r.id) for r in nearest.neighbours(filed, centres, asked.union(asked), 5).collect()}
    assert got == brute_neighbours(rows, [0, 20, 40], 5)


def test_neighbours_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    centres = nearest.fit_cells(none, 4)
    assert len(centres) == 0 and nearest.neighbours(nearest.file_vectors(none, centres), centres, none, 3).collect() == []
    one = spark.createDataFrame([(1, [0.0, 0.0])], none.schema)
    centres = nearest.fit_cells(one, 4)
    filed = nearest.file_vectors(one, centres)
    assert filed.count() == 1 and nearest.neighbours(filed, centres, one, 3).collect() == [] and nearest.neighbours(filed, centres, none, 3).collect() == []


# blocks of postings


def brute_bm25(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, text in queries:
        found = []
        for i, ws in words.items():
            score = sum(round(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * (ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean))) * 1e6) for t in set(re.findall("[a-z0-9]+", text.lower())) if t in ws)
            if score:
                found.append((-score, i))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 4, 500])
def test_block_search_is_brute_force(spark, tmp_path, k):
    random.seed(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(random.choices(words, weights=[1 / (1 + j) for j in range(30)], k=random.choice([2, 2, 2, 9, 40])))) for i in range(400)] + [(400, None), (401, "")]
    queries = [(f"q{i}", " ".join(random.sample(words, random.randint(1, 4)))) for i in range(40)] + [("none", ""), ("new", "unseen"), ("twice", "w1 W1 w2")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string")
    impacts.store_impacts(table, str(tmp_path / "i"), block=8)
    found = impacts.search_all(spark, str(tmp_path / "i"), spark.createDataFrame(queries, "query string, text string"), k)
    assert {(r.query, r.rank, r.id, round(r.score * 1e6)) for r in found.collect()} == brute_bm25(docs, queries, k)


def test_few_postings_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    impacts.store_impacts(graph.skill_texts(spark, SF), path, "id", block=4)
    asked = stored(spark.read.parquet(f"{SF}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("query")).distinct().withColumn("term", F.col("query")))
    whole = spark.read.parquet(f"{path}/blocks").join(asked, "term").agg(F.sum("rows")).first()[0]
    assert impacts.plan_blocks(spark, path, asked, 3).agg(F.sum("rows")).first()[0] < whole / 2


def test_block_search_of_an_empty_corpus(spark, tmp_path):
    impacts.store_impacts(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert impacts.search_all(spark, str(tmp_path / "i"), spark.createDataFrame([("a", "a")], "query string, text string"), 3).collect() == []


# the cut-off


def test_cut_over_all_scores(spark):
    random.seed(4)
    for case in range(12):
        scores = [round(random.uniform(-0.2, 1) * random.choice([0.4, 1]), 3) for _ in range(random.randint(0, 12))]
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, score double")
        cut = search.cut_score(rows, 0.4, 0.15).first().cut
        assert sorted(s for s in scores if cut is not None and s >= cut) == sorted(r.score for r in search.cutoff(rows, 0.4, 0.15).collect()), (case, scores)


def test_intents_are_cut_off_before_they_are_shortened(spark):
    wanted = [0.45, 0.39, 0.385, 0.38, 0.375, 0.10]
    rows = [(f"i{n}", [s, math.sqrt(1 - s * s)], ["a"]) for n, s in enumerate(wanted)]
    intents = spark.createDataFrame(rows, "intent string, embedding array<double>, skills array<string>")
    wide = spark.createDataFrame([("b", "local")], "id string, trust_tier string")
    assert [(r.id, r.rank) for r in search.semantic_search(intents, [1.0, 0.0], wide, top_k=2).collect()] == [("i0", 1), ("i1", 2)]


def test_documents_of_the_same_words_are_indexed_once(spark, tmp_path):
    """Ties of many copies, which no bound parts: the index and what a search needs of it grow with different texts only."""
    docs = [(i, ["red bolt", "Bolt, red!", "red ring", "old ring ring", "bolt"][i % 5]) for i in range(300)]
    queries = [("both", "red bolt"), ("one", "ring"), ("none", "new")]
    path = str(tmp_path / "i")
    impacts.store_impacts(spark.createDataFrame(docs, "doc_id long, text string"), path, block=8)
    asked = spark.createDataFrame([(q, t) for q, text in queries for t in text.split()], "query string, term string")
    assert impacts.plan_blocks(spark, path, asked, 100).agg(F.sum("rows")).first()[0] < 10
    assert spark.read.parquet(f"{path}/documents").count() == 4 and spark.read.parquet(f"{path}/members").count() == 300
    for k in (1, 3, 100):
        found = impacts.search_all(spark, path, spark.createDataFrame(queries, "query string, text string"), k)
        assert {(r.query, r.rank, r.id, round(r.score * 1e6)) for r in found.collect()} == brute_bm25(docs, queries, k)


def test_index_for_the_queries_alone(spark, tmp_path):
    """An index for some queries finds what the whole one does, and has no other words; documents of the same length that differ in other words are one class."""
    random.seed(5)
    docs = [(i, " ".join(random.choices("abcdefgh", k=random.randint(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "a x y"), (63, "a z w")]
    table = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([("a", "a"), ("both", "A b b"), ("none", "q"), ("empty", "")], "query string, text string")
    found = []
    for name, only in (("whole", None), ("some", asked)):
        impacts.store_impacts(table, str(tmp_path / name), "id", block=4, asked=only)
        found.append(sorted(map(tuple, impacts.search_all(spark, str(tmp_path / name), asked, 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 10
    assert {r.term for r in spark.read.parquet(str(tmp_path / "some/postings")).select("term").collect()} == {"a", "b"}
    assert len({r.id for r in spark.read.parquet(str(tmp_path / "some/members")).where("member in (62, 63)").collect()}) == 1
