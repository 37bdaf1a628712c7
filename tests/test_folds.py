"""Percentiles from brackets, budgets as folds, and searches from many roots, against brute force."""

import math
import random

import pytest

from graphwright.operators import bench, closure, search


@pytest.mark.parametrize("bracket", [3, 5_000])
def test_percentiles_are_brute_force(spark, monkeypatch, bracket):
    monkeypatch.setattr(bench, "BRACKET", bracket)
    random.seed(bracket)
    rows = [("a", random.gauss(0, 1)) for _ in range(3000)] + [("b", float(random.randint(0, 4))) for _ in range(500)] + [("c", 1.5)] + [(None, float(i)) for i in range(10)] + [("d", None)] + [("n", math.nan)] * 3
    rows += [("hot", 7.0)] * 900 + [("hot", float(i)) for i in range(100)] + [("mixed", math.nan)] + [("mixed", float(i)) for i in range(50)] + [("ends", math.inf), ("ends", -math.inf), ("ends", 0.0)]
    got = {r.k: (r.n, r.min, r.p50, r.p99, r.max) for r in bench.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", "k").collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted((v for q, v in rows if q == k and v is not None), key=lambda v: (math.isnan(v), v))
        n = len(vs)
        want[k] = (n, vs[0], vs[n * 50 // 100], vs[n * 99 // 100], vs[-1])
    assert {k: tuple(map(repr, v)) for k, v in got.items()} == {k: tuple(map(repr, v)) for k, v in want.items()}


def test_percentiles_of_whole_numbers_and_all_rows(spark):
    # whole numbers beyond a double's
    big = [(2**60 + i,) for i in range(101)]
    r = bench.percentiles(spark.createDataFrame(big, "v long"), "v").first()
    assert (r.n, r.min, r.p50, r.p99, r.max) == (101, 2**60, 2**60 + 50, 2**60 + 99, 2**60 + 100)
    assert bench.percentiles(spark.createDataFrame([], "k string, v double"), "v", "k").collect() == []


def test_no_window_over_the_values(spark, capsys):
    found = bench.percentiles(spark.createDataFrame([("a", 1.0)], "k string, v double"), "v", "k")
    found.explain()
    assert "Window" not in capsys.readouterr().out


@pytest.mark.parametrize("budget", [1, 7, 40])
def test_budget_is_the_greedy_one(spark, budget):
    random.seed(budget)
    rows = [(g, i, random.choice([None, "", "é", "x" * random.randint(1, 12), "y" * 50]), i) for g in ("u", "v", None) for i in range(60)]
    want = set()
    for g in ("u", "v", None):
        left = budget
        for q, i, text, _ in rows:
            size = len((text or "").encode())
            if q == g and size <= left:
                left -= size
                want.add((g, i))
    random.shuffle(rows)
    got = search.fit_budget(spark.createDataFrame(rows, "uri string, rank int, content string, size int").repartition(3), budget).collect()
    assert {(r.uri, r["rank"]) for r in got} == want and len(got) == len(want)


def test_budget_of_nothing(spark):
    none = spark.createDataFrame([], "uri string, rank int, content string")
    assert search.fit_budget(none, 5).collect() == [] and search.fit_budget(spark.createDataFrame([("u", 1, "a")], none.schema), 0).collect() == []


def test_searches_from_many_roots(spark):
    random.seed(6)
    names = [f"n{i}" for i in range(12)]
    edges = [(random.choice(names), random.choice(names)) for _ in range(16)] + [(None, "n1"), ("n1", None)]
    seeds = [("r1", "n0"), ("r1", "n3"), ("r2", "n3"), ("r3", "gone"), (None, "n1"), ("r4", None), ("r2", "n3")]
    want = set()
    for root, node in seeds:
        if root and node:
            left = [node]
            while left:
                at = left.pop()
                if (root, at) not in want:
                    want.add((root, at))
                    left += [b for a, b in edges if a == at and b]
    got = [tuple(r) for r in closure.reached_from(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "a string, b string")).collect()]
    assert set(got) == want and len(got) == len(want)
