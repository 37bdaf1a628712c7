"""Groups of things that share keys and pass a check, without making all pairs of a large group.

Each key's bucket has a pivot, the node that shares most with others; nodes are checked against the pivots of their
buckets first. Most of a group of near copies then lies in one component, and only pairs across
components are looked at, each in the first bucket that it shares, after a cheap test within the join. Large buckets are salted.

Tables with a row for each key of a node are joined by sort and merge. Spark sizes an exploded table as if each row gave one, and a stored one,
in which a node's facts come again and again, by its packed files; it would broadcast many times its limit through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.components import components
from graphwright.sources.scratch import drop, stored

#: Nodes outside a bucket's main component that meet the bucket's nodes in one place; more are dealt to several.
TOGETHER = 512


def linked_groups(nodes: DataFrame, facts: list[str], likely: Callable[[str, str], Column], verified: Callable[[DataFrame], DataFrame] | None = None, more: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node with links.

    nodes: (node, keys array<bigint>, facts...), a row for each node; nodes with a key in common at any place are candidates. likely(a, b)
    is a test of the columns a_<fact> and b_<fact> that no linked pair fails; verified takes pairs (a, b) to those that are
    linked, as a stored table; without it the test decides. `more` are further candidates (a, b). Nodes without keys link through `more` only.
    """

    def checked(pairs: DataFrame) -> DataFrame:
        if verified is None:
            return pairs
        out = verified(pairs)
        drop(pairs)
        return out

    index = nodes.select("node", F.explode("keys").alias("key"))
    buckets = index.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    met = index.join(buckets.hint("merge"), "key").where("node != least").select("node", "key", "size").union(buckets.select("least", "key", "size"))
    # a node's shared keys, as many as it has at most: what is looked up by node is looked up once, not for each key
    held = stored(met.groupBy("node").agg(F.collect_list("key").alias("shared"), F.sum("size").alias("degree")), release=True)
    pivots = held.select("node", "degree", F.explode("shared").alias("key")).groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"))
    pivots = stored(pivots)

    def of(x: str, *also: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), *[F.col(f).alias(f"{x}_{f}") for f in (*facts, *also)])

    star = held.select("node", F.explode("shared").alias("key")).join(pivots.hint("merge"), "key").where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = star.join(of("a"), "a").join(of("b"), "b").where(likely("a", "b")).select("a", "b")
    near = checked(stored((star if more is None else star.union(more)).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), release=True))
    groups = components(near)
    # nodes outside the component of a bucket's pivot; buckets without any are done
    placed = stored(held.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "shared"))
    main = pivots.join(groups.withColumnRenamed("node", "pivot"), "pivot", "left").select("key", F.coalesce("component", "pivot").alias("main"))
    spread = placed.select("node", "component", F.explode("shared").alias("key"))
    outside = spread.join(main.hint("merge"), "key").where("component != main").groupBy("key", "main").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    rows = spread.join(outside.hint("merge"), "key").withColumn("outside", F.col("component") != F.col("main"))
    rows = stored(rows.join(of("node", "keys").select("node", *[F.col(f"node_{f}").alias(f) for f in (*facts, "keys")]), "node").drop("main"), release=True)
    drop(held, pivots, placed, groups)
    left, right = (rows.select("key", "salts", F.col("node").alias(x), *[F.col(f).alias(f"{x}_{f}") for f in ("component", "outside", "keys", *facts)]) for x in "ab")
    left = left.where("a_outside").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    first = F.element_at("a_keys", F.array_position(F.zip_with("a_keys", "b_keys", lambda x, y: x == y), True).cast("int"))
    once = (F.col("a_component") != F.col("b_component")) & (~F.col("b_outside") | (F.col("a") < F.col("b")))
    cross = left.join(right.hint("merge"), ["key", "salt"]).where(once & likely("a", "b") & (first == F.col("key")))
    far = checked(stored(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    drop(rows)
    out = components(near.union(far))
    drop(near, far)
    return out
