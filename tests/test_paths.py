"""Paths of any form against a set-based brute force, and the SELECT front-end's negation, nesting and sums."""

import random

import pytest

from graphwright.operators import paths
from graphwright.plans import sparql

TRIPLES = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def graph(spark, rows):
    return spark.createDataFrame([("g", s, "iri", p, o, kind, None, None) for s, p, o, kind in rows], TRIPLES)


def brute(rows, e):
    """Pairs of nodes, a node being its text and kind."""
    triples = [((s, False), p, (o, kind == "literal")) for s, p, o, kind in rows]
    nodes = {n for s, _, o in triples for n in (s, o)}
    kind = e[0]
    if kind == "iri":
        return {(s, o) for s, p, o in triples if p == e[1]}
    if kind == "inverse":
        return {(o, s) for s, o in brute(rows, e[1])}
    if kind == "sequence":
        a, b = brute(rows, e[1]), brute(rows, e[2])
        return {(s, o) for s, m in a for n, o in b if m == n}
    if kind == "alternative":
        return set().union(*(brute(rows, x) for x in e[1]))
    if kind == "negated":
        out = set()
        for back in (False, True):
            names = [p for p, i in e[1] if i == back]
            if names or (not back and not e[1]):
                found = {(s, o) for s, p, o in triples if p not in names}
                out |= {(o, s) for s, o in found} if back else found
        return out
    once = brute(rows, e[1])
    out = set(once)
    while e[3] and (more := {(s, o) for s, m in out for n, o in once if m == n} - out):
        out |= more
    return out | ({(n, n) for n in nodes} if e[2] else set())


A, B_, C = ("iri", "oc:a"), ("iri", "oc:b"), ("iri", "oc:c")
CASES = [
    ("repeat", ("sequence", A, B_), False, True),
    ("repeat", ("alternative", [A, ("inverse", B_)]), True, True),
    ("repeat", ("sequence", A, ("repeat", B_, True, True)), False, True),
    ("repeat", ("sequence", ("inverse", ("sequence", A, C)), B_), True, False),
    ("repeat", ("inverse", ("repeat", ("alternative", [("sequence", A, B_), C]), False, True)), False, True),
    ("repeat", ("negated", [("oc:a", False)]), False, True),
    ("negated", [("oc:a", False), ("oc:b", True)]),
    ("sequence", ("repeat", A, True, False), ("negated", [("oc:c", True)])),
]


@pytest.mark.parametrize("e", CASES, ids=range(len(CASES)))
def test_paths_are_brute_force(spark, e):
    random.seed(str(e))
    nodes = [f"oc:n{i}" for i in range(7)]
    # literals with the text of a node
    rows = {(random.choice(nodes), random.choice(["oc:a", "oc:b", "oc:c"]), random.choice(nodes), random.choice(["iri", "iri", "literal"])) for _ in range(14)}
    t = graph(spark, rows)
    want = brute(rows, e)
    assert {((r.src, r.src_literal), (r.dst, r.dst_literal)) for r in paths.search(t, e).collect()} == want
    seeds = spark.createDataFrame([("oc:n1", False), ("oc:n2", True), ("gone", False)], "node string, literal boolean")
    some = {((r.src, r.src_literal), (r.dst, r.dst_literal)) for r in paths.search(t, e, seeds).collect()}
    zero = e[0] == "repeat" and e[2]
    starts = {("oc:n1", False), ("oc:n2", True), ("gone", False)}
    assert some == {(s, o) for s, o in want if s in starts} | ({(s, s) for s in starts} if zero else set())


def test_paths_of_an_empty_graph(spark):
    assert paths.search(graph(spark, []), CASES[1]).collect() == []


@pytest.fixture(scope="module")
def small(spark):
    iri, lit = "iri", "literal"
    return graph(spark, [
        ("oc:x", "oc:p", "oc:y", iri), ("oc:y", "oc:p", "oc:z", iri), ("oc:z", "oc:p", "oc:x", iri), ("oc:x", "oc:name", "ex", lit), ("oc:y", "oc:name", "why", lit), ("oc:z", "oc:name", "zed", lit),
        ("oc:x", "oc:n", "3", lit), ("oc:y", "oc:n", "4", lit), ("oc:y", "oc:q", "oc:x", iri), ("oc:w", "oc:p", "oc:w", iri), ("oc:w", "oc:name", "oc:x", lit),
    ])


def run(t, text):
    return sorted(map(repr, (tuple(r) for r in sparql.select(t, text).collect())))


def said(*rows):
    return sorted(map(repr, rows))


def test_negation(small):
    # MINUS without a variable in common takes nothing away; NOT EXISTS takes all
    assert len(run(small, "SELECT ?s WHERE { ?s oc:n ?n MINUS { ?a oc:q ?b } }")) == 2
    assert run(small, "SELECT ?s WHERE { ?s oc:n ?n FILTER NOT EXISTS { ?a oc:q ?b } }") == []
    assert len(run(small, "SELECT ?s WHERE { ?s oc:n ?n FILTER EXISTS { ?a oc:q ?b } }")) == 2
    assert run(small, "SELECT ?s WHERE { ?s oc:p ?o MINUS { ?s oc:n ?n } }") == said(("oc:z",), ("oc:w",))
    # a condition within sees the variables without, in EXISTS only
    assert run(small, "SELECT ?s WHERE { ?s oc:p ?o FILTER NOT EXISTS { ?s oc:p ?x FILTER(?x = ?o) } }") == []
    assert len(run(small, "SELECT ?s WHERE { ?s oc:p ?o MINUS { ?s oc:p ?x FILTER(?x = ?o) } }")) == 4
    with pytest.raises(sparql.QueryError):
        sparql.select(small, "SELECT ?s WHERE { ?s oc:p ?o FILTER(EXISTS { ?s oc:n ?n } || ?o = oc:w) }")


def test_nested_negation_by_hand(small):
    # x -> y -> z -> x, w -> w; only x and y have n. o's next without n: z (of y's next) and w
    found = run(small, "SELECT ?s WHERE { ?s oc:p ?o FILTER NOT EXISTS { ?o oc:p ?x FILTER NOT EXISTS { ?x oc:n ?n } } }")
    step, has = {"oc:x": "oc:y", "oc:y": "oc:z", "oc:z": "oc:x", "oc:w": "oc:w"}, {"oc:x", "oc:y"}
    assert found == said(*[(s,) for s, o in step.items() if step[o] in has])


def test_minus_with_unbound_variables(small):
    # n is unbound for z and w: they agree in s alone
    text = "SELECT ?s ?n WHERE { ?s oc:p ?o OPTIONAL { ?s oc:n ?n } MINUS { ?s oc:name ?m OPTIONAL { ?s oc:n ?n } FILTER(?m != \"ex\") } }"
    assert run(small, text) == said(("oc:x", "3"))
    assert run(small, "SELECT ?s WHERE { ?s oc:p ?o OPTIONAL { ?s oc:n ?n } MINUS { VALUES ?n { \"3\" } } }") == said(("oc:y",), ("oc:z",), ("oc:w",))


def test_values_and_nested_queries(small):
    assert run(small, "SELECT ?s ?v WHERE { VALUES (?s ?v) { (oc:x 1) (oc:z UNDEF) (oc:gone 2) } ?s oc:p ?o }") == said(("oc:x", "1"), ("oc:z", None))
    assert run(small, "SELECT ?s WHERE { ?s oc:p ?o } VALUES ?o { oc:y oc:w }") == said(("oc:x",), ("oc:w",))
    assert len(run(small, "SELECT ?s ?k WHERE { ?s oc:n ?n VALUES ?k { 1 2 3 } }")) == 6
    assert run(small, "SELECT ?s ?m WHERE { ?s oc:n ?n { SELECT (MAX(?x) AS ?m) ?s WHERE { ?s oc:n ?x } GROUP BY ?s } }") == said(("oc:x", "3"), ("oc:y", "4"))
    # LIMIT within
    assert run(small, "SELECT ?n WHERE { { SELECT ?s WHERE { ?s oc:name ?n } ORDER BY DESC(?n) LIMIT 1 } ?s oc:name ?n }") == said(("zed",))


def test_groups_and_sums(small):
    assert run(small, "SELECT ?o (COUNT(*) AS ?c) WHERE { ?s oc:p ?o } GROUP BY ?o HAVING(COUNT(*) > 1)") == []
    assert run(small, "SELECT ((SUM(?n) + 1) * 2 AS ?x) WHERE { ?s oc:n ?n }") == said((16.0,))
    assert run(small, "SELECT ?k (COUNT(*) AS ?c) WHERE { ?s oc:name ?n } GROUP BY (STRLEN(?n) AS ?k) ORDER BY DESC(COUNT(*)) LIMIT 1") == said(("3", 2))
    assert run(small, "SELECT (?n -1 AS ?x) (-?n / 2 AS ?y) (?n / 0 AS ?z) WHERE { oc:x oc:n ?n }") == said((2.0, -1.5, None))
    with pytest.raises(sparql.QueryError):
        sparql.select(small, "SELECT ?s (COUNT(*) AS ?c) WHERE { ?s oc:p ?o } GROUP BY ?o")


def test_paths_in_patterns(small):
    assert run(small, "SELECT ?o WHERE { oc:x (oc:p/oc:p)+ ?o }") == said(("oc:x",), ("oc:y",), ("oc:z",))
    assert run(small, "SELECT ?s WHERE { ?s oc:p*/oc:n ?n } ") == said(*[("oc:x",), ("oc:y",), ("oc:z",)] * 2)
    # alternatives keep repeats, repeated paths don't
    assert run(small, "SELECT ?o WHERE { oc:y (oc:p|oc:p|oc:q) ?o }") == said(("oc:z",), ("oc:z",), ("oc:x",))
    assert run(small, "SELECT ?s WHERE { ?s ^oc:q oc:y }") == said(("oc:x",))
    assert run(small, "SELECT ?o WHERE { oc:y !(oc:p|oc:name) ?o }") == said(("oc:x",), ("4",))
    # a literal with the text of a node isn't that node
    assert run(small, "SELECT ?s WHERE { ?s oc:name* \"oc:x\" }") == said(("oc:w",), ("oc:x",)) and run(small, "SELECT ?o WHERE { oc:w oc:name/oc:n ?o }") == []
    assert run(small, "SELECT ?o WHERE { oc:gone oc:p* ?o }") == said(("oc:gone",))
    assert run(small, "SELECT ?b WHERE { oc:y oc:q? ?b . ?b oc:n ?n }") == said(("oc:x",), ("oc:y",))
