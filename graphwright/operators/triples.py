"""The triple table and the access paths to it.

A graph is a table of (graph_id, s, s_kind, p, o, o_kind, o_dt, o_lang). Written
as Parquet it should be clustered by `p`, since almost every access names a predicate: the
filter then prunes row groups, and only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
TYPE = "rdf:type"


def distinct_triples(t: DataFrame, tasks: int | None = None) -> DataFrame:
    """Set semantics of a graph: each triple once in each graph. With `tasks`, by so many tasks, however small the triples pack: a task holds all of its own at once."""
    if tasks:
        t = t.repartition(tasks, "graph_id", "s", "p", "o")
    return t.dropDuplicates(["graph_id", "s", "p", "o", "o_kind", "o_dt", "o_lang"])


def merged(t: DataFrame) -> DataFrame:
    """The graphs of a table as one: each triple once, whatever graphs it is in. Operators read their table as one graph, so a table of several is merged once, when it is stored."""
    return t.groupBy("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").agg(F.min("graph_id").alias("graph_id")).select(t.columns)


def store(t: DataFrame, path: str) -> None:
    """A merged table as Parquet clustered by predicate and subject, so that what names a predicate reads its row groups only."""
    merged(t).repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(path)


def facts(t: DataFrame, predicate: str, s: str = "s", o: str = "o", kind: str | None = None) -> DataFrame:
    """(s, o) of one predicate, under names of the caller's choice; kind keeps only objects of it (iri, bnode or literal)."""
    rows = t.where(F.col("p") == predicate)
    if kind:
        rows = rows.where(F.col("o_kind") == kind)
    return rows.select(F.col("s").alias(s), F.col("o").alias(o))


def star(t: DataFrame, single: Sequence[str], several: Sequence[str] = ()) -> DataFrame:
    """One row for each subject, a column for each predicate: one aggregation instead of a self-join for each.

    `single` predicates give their least object, `several` a sorted array of distinct ones (empty if there are none).
    Columns have the predicates' local names.
    """
    name = lambda p: p.split(":")[-1]
    one = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name(p)) for p in single]
    many = [F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(name(p)) for p in several]
    return t.where(F.col("p").isin(*single, *several)).groupBy("s").agg(*one, *many)


def of_class(t: DataFrame, *classes: str) -> DataFrame:
    """Distinct subjects of any of some classes."""
    return t.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("s").distinct()


def as_long(o: Column) -> Column:
    """A literal as bigint, null if it is none."""
    return o.try_cast("bigint")


def as_boolean(o: Column) -> Column:
    """A literal as boolean, null if it is none."""
    return o.try_cast("boolean")


