"""Connected components of a graph whose edges lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.sources.scratch import drop, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until a round changes
    nothing; each round is two aggregations and two joins, which adaptive execution splits at
    hubs, and its result is written to a table. Edges from a node to itself, repeated edges and edges
    with a null end add nothing. An empty table gives an empty table.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs, before = stored(pairs), None
    while True:
        # large-star: neighbours above a node go to the smallest of the node and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, pairs = pairs, stored(small)
        drop(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
    out.stored_at = pairs.stored_at  # for `drop`
    return out
