"""Inference to the fixpoint against a naive one, with equality; representatives of connected nodes."""

import random

import pytest

from graphwright.operators import catalog, closure, reason

from graphwright.sources import star_graph as sg

TRIPLES = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def table(spark, links):
    return spark.createDataFrame([("g", s, "iri", p, o, "iri", None, None) for s, p, o in links], TRIPLES)


AXIOMS = reason.Axioms(
    inverses=[("a", "ia")], symmetric=["m"], transitive=["t"], sub_properties=[("a", "b"), ("b", "c")], equivalent=[("c", "d")], chains=[("x", ("a", "t"))],
    domains=[("b", ("B", None)), ("t", ("T", "T"))], functional=["f"], inverse_functional=["g"], equivalent_classes=[("B", "E")],
)
SUB = [("T", "Top"), ("E", "Top")]


def naive(links):
    """All rules on all facts until nothing is new; equality by merging names."""
    facts, parent = set(links), {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    while True:
        new = set(facts)
        for s, p, o in facts:
            new |= {(o, q, s) for q in {"a": ["ia"], "ia": ["a"], "m": ["m"]}.get(p, [])}
            new |= {(s, q, o) for q in {"a": ["b"], "b": ["c"], "c": ["d"], "d": ["c"]}.get(p, [])}
            new |= {(s, "rdf:type", c) for c in {"b": ["B"], "t": ["T"]}.get(p, [])} | ({(o, "rdf:type", "T")} if p == "t" else set())
            if p == "rdf:type":
                new |= {(s, p, c) for c in {"T": ["Top"], "E": ["Top", "B"], "B": ["E"]}.get(o, [])}
            for s2, p2, o2 in facts:
                if o == s2 and (p, p2) in (("t", "t"), ("a", "t")):
                    new.add((s, "t" if p == "t" else "x", o2))
                pairs = [(o, o2)] if p == p2 == "f" and s == s2 else [(s, s2)] if p == p2 == "g" and o == o2 else []
                for u, v in pairs:
                    if find(u) != find(v):
                        parent[max(find(u), find(v))] = min(find(u), find(v))
            if p == reason.SAME and find(s) != find(o):
                parent[max(find(s), find(o))] = min(find(s), find(o))
        new = {(find(s), p, find(o)) for s, p, o in new if p != reason.SAME} | {(s, p, o) for s, p, o in new if p == reason.SAME and find(s) != find(o)}
        if new == facts:
            return {f for f in facts if f[1] != reason.SAME}, {x: find(x) for x in parent}
        facts = new


@pytest.mark.parametrize("seed", range(4))
def test_fixpoint_is_the_naive_one(spark, seed):
    random.seed(seed)
    nodes = [f"n{i:02}" for i in range(14)]
    links = {(random.choice(nodes), random.choice(["a", "b", "m", "t", "t", "f", "g", reason.SAME if seed % 2 else "a"]), random.choice(nodes)) for _ in range(22)}
    found, same, added = reason.fixpoint(table(spark, links), SUB, AXIOMS)
    want, classes = naive(links)
    assert {tuple(r) for r in found.collect()} == want
    assert {r.node: r.representative for r in same.collect() if r.node != r.representative} == classes
    assert sum(added) >= 0


def test_rounds_join_what_is_new(spark):
    """A chain of 33 steps closes in a few rounds of falling size, for lengths double; nothing is found twice."""
    found, same, added = reason.fixpoint(table(spark, [(f"n{i:02}", "t", f"n{i + 1:02}") for i in range(33)]), [], reason.Axioms([], [], ["t"], [], [], [], []))
    assert sum(added) == 33 * 34 // 2 - 33 and len(added) <= 6 and added[-1] < max(added) and same.count() == 0 and found.count() == 33 * 34 // 2


def test_inference_of_an_empty_graph(spark):
    found, same, added = reason.fixpoint(table(spark, []), SUB, AXIOMS)
    assert found.collect() == same.collect() == [] == added


def test_inference_of_the_catalogue_is_its_rules(spark):
    t = sg.graph(spark, "/root/testdata/sf0.001")
    found = reason.infer(t, catalog.class_tree())
    links = t.where("o_kind <> 'literal'").select("s", "p", "o")
    for rule in (reason.inverse, reason.symmetric, reason.sub_properties, reason.chains):
        assert rule(links).join(found, ["s", "p", "o"], "left_anti").isEmpty()
    assert reason.types(links, catalog.class_tree()).join(found, ["s", "p", "o"], "left_anti").isEmpty()


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_representatives(spark, shape):
    random.seed(shape)
    names = [f"v{i:03}" for i in range(60)]
    random.shuffle(names)
    edges = {"path": list(zip(names, names[1:])), "star": [(names[0], x) for x in names[1:]], "random": [(random.choice(names), random.choice(names)) for _ in range(40)], "loops": [(x, x) for x in names[:5]] + [(None, "x"), ("x", None)]}[shape]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            for x in (a, b):
                parent.setdefault(x, x)
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.representative for r in closure.representatives(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_links_are_written_once(spark, monkeypatch):
    """A chain of 33 steps: a round writes what it adds, not all that is known again, and what a closure adds isn't turned round twice."""
    written, keep = [], closure.stored
    for module in (closure, reason):
        monkeypatch.setattr(module, "stored", lambda df: (written.append(df.count()), keep(df))[1])
    found = reason.infer(table(spark, [(f"n{i:02}", "t", f"n{i + 1:02}") for i in range(33)]), [], reason.Axioms([("t", "it")], [], ["t"], [], [], [], [("t", ("T", "T"))]))
    assert found.count() == 33 * 34 + 34 and sum(written) <= found.count() + 2 * 33


@pytest.mark.parametrize("seed", range(2))
def test_inheritance_along_a_closure(spark, seed):
    """What is handed on along a transitive property, with classes of its ends, inverses, and nodes that turn out the same, against all rules on all facts."""
    random.seed(seed)
    nodes = [f"n{i:02}" for i in range(12)]
    links = {(random.choice(nodes), random.choice(["t", "t", "k", "h", "it", "f", "j"]), random.choice(nodes)) for _ in range(16)}
    axioms = reason.Axioms([("t", "it"), ("k", "t2"), ("h", "t2")], [], ["t"], [("k", "h"), ("j", "t")], [], [("h", ("t", "h"))], [("t", ("T", "R")), ("it", ("I", None))], ["f"] * seed)
    facts, same = set(links), {}
    while True:
        name = lambda x: name(same[x]) if x in same else x
        new = {(o, q, s) for s, p, o in facts for q in {"t": ["it"], "it": ["t"], "k": ["t2"], "h": ["t2"], "t2": ["k", "h"]}.get(p, [])}
        new |= {(s, {"k": "h", "j": "t"}[p], o) for s, p, o in facts if p in ("k", "j")} | {(s, p2, o2) for s, p, o in facts for s2, p2, o2 in facts if p == "t" and o == s2 and p2 in ("t", "h")}
        new |= {x for s, p, o in facts for x in {"t": [(s, "rdf:type", "T"), (o, "rdf:type", "R")], "it": [(s, "rdf:type", "I")]}.get(p, [])} | facts
        for s, p, o in facts if seed else ():
            for s2, p2, o2 in facts:
                if p == p2 == "f" and s == s2 and name(o) != name(o2):
                    same[max(name(o), name(o2))] = min(name(o), name(o2))
        new = {(name(s), p, name(o)) for s, p, o in new}
        if new == facts:
            break
        facts = new
    assert {tuple(r) for r in reason.infer(table(spark, links), [], axioms).collect()} == facts
