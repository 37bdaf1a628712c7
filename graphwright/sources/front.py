"""Front matter of documents: fields in the common forms of YAML, names of fields that mean the same, and what a document must say.

Read by Column functions within each row. Of YAML these forms are known: `key: value`, quoted values, `[a, b]`, lists of `- item` lines, texts after `|` and `>`, values that go on in
indented lines, and comments. Nested mappings stay text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of a field, the first of those that are there counts; the field's own name comes before them.
OTHER_NAMES = {
    "category": ("categories", "type", "skill_type", "domain"), "version": ("skill_version", "ver"), "license": ("licence", "spdx"), "is_user_invocable": ("user_invocable", "invocable", "interactive"),
    "argument_hint": ("arguments", "args", "parameters"), "allowed_tools": ("tools", "required_tools", "tool_whitelist"), "aliases": ("alias", "also_known_as", "tags"), "depends_on": ("depends_on_skills", "dependencies", "requires"),
}
#: Names that no skill may have.
RESERVED = ("index",)
MOST_NAME, MOST_DESCRIPTION = 64, 1024


def raw(text: Column) -> Column:
    """What stands between the `---` lines that a text begins with; null if it doesn't."""
    found = "(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n.*)?\\z"
    return F.when(text.rlike(found), F.replace(F.regexp_extract(text, found, 1), F.lit("\r\n"), F.lit("\n")))


def _plain(value: Column) -> Column:
    """A value without its comment, or without its quotes."""
    trimmed = F.trim(value)
    quoted = trimmed.rlike("^\"[^\"]*\"|^'[^']*'")
    return F.when(quoted, F.regexp_extract(trimmed, "^([\"'])(.*?)\\1", 2)).otherwise(F.trim(F.regexp_replace(trimmed, "(^|\\s)#.*$", "")))


def pairs(raw: Column) -> Column:
    """array<struct<k, v array<string>>> of front matter: each field with its value, or the members of its list. A step builds on the columns of the one before, so that nothing is worked out twice."""
    entries = F.filter(F.split(F.concat(F.lit("\n"), raw), "\n(?=[A-Za-z_][\\w-]*[ \\t]*:(?:\\s|$))"), lambda e: e.rlike("^[A-Za-z_][\\w-]*[ \\t]*:"))
    cut = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, "^([\\w-]+)", 1).alias("k"), F.regexp_replace(e, "^[\\w-]+[ \\t]*:[ \\t]*", "").alias("rest")))
    cut = F.transform(cut, lambda x: F.struct(x["k"].alias("k"), F.split(x["rest"], "\n").alias("all")))
    cut = F.transform(cut, lambda x: F.struct(x["k"].alias("k"), x["all"][0].alias("head"), _plain(x["all"][0]).alias("plain"), F.filter(F.slice(x["all"], 2, 1_000_000), lambda y: ~y.rlike("^\\s*#")).alias("lines")))
    cut = F.transform(cut, lambda x: F.struct(x["k"].alias("k"), x["head"].alias("head"), x["plain"].alias("plain"), x["lines"].alias("lines"), F.filter(x["lines"], lambda y: F.trim(y) != "").alias("filled")))

    def value(x: Column) -> Column:
        head, filled = x["head"], x["filled"]
        inside = F.regexp_extract(F.concat_ws(" ", head, F.transform(filled, lambda y: F.trim(y))), "^\\[(.*)\\]", 1)
        indent = F.length(filled[0]) - F.length(F.ltrim(filled[0]))
        kept = F.regexp_replace(F.array_join(F.transform(x["lines"], lambda y: F.substring(y, indent + 1, F.length(y))), "\n"), "\\n+\\z", "")
        folded = F.array_join(F.transform(filled, lambda y: F.trim(y)), " ")
        return (
            F.when(head.rlike("^\\["), F.filter(F.transform(F.split(inside, ","), lambda y: _plain(y)), lambda y: y != ""))
            .when((x["plain"] == "") & (F.size(filled) > 0) & F.forall(filled, lambda y: y.rlike("^\\s*-(\\s|$)")), F.transform(filled, lambda y: _plain(F.regexp_replace(y, "^\\s*-\\s*", ""))))
            .when(head.rlike("^\\|[-+]?\\s*$"), F.array(kept))
            .when(head.rlike("^>[-+]?\\s*$"), F.array(folded))
            .when(F.size(filled) > 0, F.array(F.trim(F.concat_ws(" ", x["plain"], folded))))
            .when(F.trim(head).isin("", "~", "null"), F.array().cast("array<string>"))
            .otherwise(F.array(x["plain"]))
        )

    return F.transform(cut, lambda x: F.struct(x["k"].alias("k"), value(x).alias("v")))


def fields(pairs: Column) -> Column:
    """map<string, array<string>> of the pairs of front matter. Of a repeated field the last counts; a field without a value has none."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def named(found: Column) -> Column:
    """Fields with those added that stand under another name."""
    has = lambda name: F.map_contains_key(found, F.lit(name))
    more = []
    for name, others in OTHER_NAMES.items():
        value: Column = F.lit(None).cast("array<string>")
        for other in reversed(others):
            value = F.when(has(other), found[other]).otherwise(value)
        there = ~has(name) & F.exists(F.array(*[has(o) for o in others]), lambda x: x)
        more.append(F.when(there, F.struct(F.lit(name).alias("key"), value.alias("value"))))
    return F.map_concat(found, F.map_from_entries(F.filter(F.array(*more), lambda m: m.isNotNull())))


def skill_name(name: Column) -> Column:
    """Small letters, digits and hyphens; all else becomes a hyphen, and several become one."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def front_matter(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reserved: Sequence[str] = RESERVED) -> DataFrame:
    """(id, name, description, version, fields, error) of each document. `error` says what is wrong: `missing`, `no name`, `no description`, `name` (empty, too long or reserved), `description` (too long, or with tags); null if nothing is.

    Null and empty texts are missing their front matter. Repeated rows are read each. Lists under a name that wants one value give their first. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("id"), raw(F.col(text_column)).alias("raw"))
    rows = rows.select("id", pairs(F.col("raw")).alias("pairs")).select("id", fields(F.col("pairs")).alias("found")).select("id", named(F.col("found")).alias("fields"))
    first = lambda name: F.when(F.size(F.col("fields")[name]) > 0, F.col("fields")[name][0])
    rows = rows.select("id", first("name").alias("given"), first("description").alias("description"), first("version").alias("version"), "fields").withColumn("name", skill_name(F.col("given")))
    error = F.when(F.col("fields").isNull(), "missing").when(F.col("given").isNull(), "no name").when(F.col("description").isNull(), "no description")
    error = error.when((F.col("name") == "") | (F.length("name") > MOST_NAME) | F.col("name").isin(*reserved), "name")
    error = error.when((F.length("description") > MOST_DESCRIPTION) | F.col("description").rlike("<[a-zA-Z][^>]*>"), "description")
    return rows.select("id", "name", "description", "version", "fields", error.alias("error"))
