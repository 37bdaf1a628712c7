"""Front matter: forms of values, other names of fields, and what must be there."""

from graphwright.sources import front

GOOD = """---
name: "My Skill: one_two"
description: >
  What it does,
  in two lines
tags: [a, 'b c', "d"]   # a comment
tools:
  - git
  - "make # not a comment"
# nothing
license: MIT # as given
type: x
category: own
long: first
  goes on
text: |
    kept
      as it is

empty:
none: ~
nested:
  a: 1
ver: 1.2
name_2: 'it''s'
---
body: no
"""


def read(spark, *texts):
    rows = front.front_matter(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, name string, fields int")).collect()
    return {r.id: r for r in rows}


def test_forms_and_names(spark):
    r = read(spark, GOOD, GOOD.replace("\n", "\r\n"))
    for one in (r[0], r[1]):
        f = one.fields
        assert (one.error, one.name, one.description, one.version) == (None, "my-skill-one-two", "What it does, in two lines", "1.2")
        assert f["aliases"] == f["tags"] == ["a", "b c", "d"] and f["allowed_tools"] == f["tools"] == ["git", "make # not a comment"] and f["license"] == ["MIT"] and f["category"] == ["own"] and f["type"] == ["x"]
        assert f["long"] == ["first goes on"] and f["text"] == ["kept\n  as it is"] and f["empty"] == f["none"] == [] and f["nested"] == ["a: 1"] and "body" not in f and "depends_on" not in f


def test_what_is_wrong(spark):
    head = "---\n{}\n---"
    texts = {
        "missing": [None, "", "no front", "---\nname: a\ndescription: b", "x\n---\nname: a\n---", " ---\nname: a\n---"],
        "no name": [head.format("description: b"), head.format("name:\ndescription: b"), head.format("just text")],
        "no description": [head.format("name: a")],
        "name": [head.format("name: '!!'\ndescription: b"), head.format(f"name: {'a' * 65}\ndescription: b"), head.format("name: Index\ndescription: b")],
        "description": [head.format(f"name: a\ndescription: {'b' * 1025}"), head.format("name: a\ndescription: has <b>tags</b>")],
        None: [head.format("name: a\ndescription: 1 < 2 > 1"), head.format("name: a-b_c\ndescription: b") + "\nrest\n---\n", head.format("name: a\nname: b\ndescription: c")],
    }
    flat = [(want, t) for want, some in texts.items() for t in some]
    got = read(spark, *[t for _, t in flat])
    assert [got[i].error for i in range(len(flat))] == [want for want, _ in flat]
    assert got[len(flat) - 1].name == "b" and got[len(flat) - 2].name == "a-b-c" and read(spark) == {}
