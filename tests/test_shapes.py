"""Shapes as data: constraints from a graph of shapes, lists, and what they find."""

import pytest

from graphwright.operators import catalog, shapes
from graphwright.operators.triples import SCHEMA
from graphwright.sources import turtle

TOP = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def graph(spark, text):
    rows = turtle.parse(f"@prefix oc: <http://example.org/ontology#> . {TOP}{text}")
    return spark.createDataFrame([("g", s, sk, p, o, k, dt, lang) for s, sk, p, o, k, dt, lang in rows], SCHEMA)


def found(spark, shape_text, data_text):
    got = shapes.validate(graph(spark, data_text), catalog.class_tree(), shapes.read(graph(spark, shape_text)))
    return {(r.focus, r.path, r.kind, r.value) for r in got.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_lists_of_any_length(spark, n):
    g = graph(spark, "oc:x oc:p ( " + " ".join(f'"v{i}"' for i in range(n)) + " ) ; oc:q ( oc:y ) .")
    heads = {r.p: r.o for r in g.where("s = 'oc:x'").collect()}
    rows = sorted((r.head, r.n, r.o) for r in shapes.lists(g).collect())
    assert rows == sorted([(heads["oc:p"], i, f"v{i}") for i in range(n)] + [(heads["oc:q"], 0, "oc:y")])


def test_lists_that_go_round_or_are_empty(spark):
    with pytest.raises(ValueError):
        shapes.lists(graph(spark, "oc:a rdf:first 1 ; rdf:rest oc:b . oc:b rdf:first 2 ; rdf:rest oc:a ."))
    assert shapes.lists(graph(spark, "oc:x oc:p () .")).collect() == []


def test_constraints_of_a_graph(spark):
    text = """oc:S a sh:NodeShape ; sh:targetClass oc:Skill ; sh:targetSubjectsOf oc:u ; sh:targetNode oc:n ;
      sh:property [ sh:path oc:a ; sh:minCount 1 ; sh:maxCount 2 ; sh:in ("x" "y") ; sh:message "m" ] , [ sh:path [ sh:inversePath oc:b ] ; sh:minCount 1 ; sh:severity sh:Warning ] ,
      [ sh:path oc:c ; sh:pattern "^a" ; sh:flags "i" ; sh:minLength 2 ; sh:maxLength 3 ] , [ sh:path oc:d ; sh:minInclusive 1 ; sh:maxInclusive 5 ; sh:hasValue 3 ] , [ sh:path oc:e ; sh:nodeKind sh:BlankNodeOrIRI ] ;
      sh:or ( [ sh:path oc:f ; sh:minCount 1 ] [ sh:path oc:g ; sh:minCount 1 ] ) .
    oc:Off a sh:NodeShape ; sh:deactivated true ; sh:targetClass oc:Skill ; sh:property [ sh:path oc:z ; sh:minCount 1 ] ."""
    data = """oc:s a oc:ExecutableSkill ; oc:a "x", "z", "y" ; oc:c "Abcd", "b" ; oc:d 6, "word" ; oc:e "text", oc:o ; oc:g 1 .
    oc:t oc:b oc:n . oc:n oc:a "y" ; oc:d 3 ; oc:f 1 . oc:w oc:u oc:x ; oc:a "x" ; oc:d 3.0 , 3 ; oc:c "ab" . oc:v oc:b oc:w ."""
    assert found(spark, text, data) == {
        ("oc:s", "oc:a", "max", "3"), ("oc:s", "oc:a", "in", "z"), ("oc:s", "^oc:b", "min", "0"), ("oc:s", "oc:c", "longest", "Abcd"), ("oc:s", "oc:c", "pattern", "b"), ("oc:s", "oc:c", "shortest", "b"),
        ("oc:s", "oc:d", "most", "6"), ("oc:s", "oc:d", "least", "word"), ("oc:s", "oc:d", "most", "word"), ("oc:s", "oc:d", "value", "0"), ("oc:s", "oc:e", "node", "text"), ("oc:w", "oc:f", "or", "0"),
    }
    kinds = {c.severity for c in shapes.read(graph(spark, text))}
    assert kinds == {"Violation", "Warning"}


def test_what_is_not_known_is_an_error(spark):
    for wrong in ("sh:property [ sh:path oc:a ; sh:uniqueLang true ]", "sh:closed true", "sh:or ( [ sh:path oc:a ; sh:maxCount 1 ] )"):
        with pytest.raises(ValueError):
            shapes.read(graph(spark, f"oc:S sh:targetClass oc:C ; {wrong} ."))


def test_the_vocabularys_own_shapes(spark):
    rules = shapes.read(shapes.vocabulary(spark))
    assert len({c.shape for c in rules}) == 17
    by = {(c.shape, c.target, c.path, c.kind): (c.argument, c.severity) for c in rules}
    assert by["ExecutionPayload", "oc:ExecutionPayload", "oc:executor", "in"] == (("shell", "python", "node", "claude_tool"), "Violation")
    assert by["ExecutionPayload", "oc:ExecutionPayload", "oc:code|oc:executionPath", "or"][1] == "Violation" and by["Skill", "oc:Skill", "oc:dependsOnSkill", "class"] == ("oc:Skill", "Warning")
    assert by["KnowledgeNode", "*oc:impartsKnowledge", "oc:directiveContent", "max"] == (1, "Violation") and by["BulletList", "oc:BulletList", "oc:hasItem", "class"] == ("oc:BulletItem", "Violation")
    assert shapes.validate(graph(spark, ""), catalog.class_tree(), rules).collect() == [] and shapes.read(graph(spark, "")) == ()
    good = 'oc:l a oc:BulletList ; oc:hasItem oc:i . oc:i a oc:BulletItem ; oc:itemText "a" ; oc:itemOrder 1 . oc:q a oc:BlockQuote ; oc:quoteContent "x" ; oc:contentOrder 2 ; oc:quoteAttribution "a" , "b" .'
    assert {(r.focus, r.kind) for r in shapes.validate(graph(spark, good), catalog.class_tree(), rules).collect()} == {("oc:q", "max")}
