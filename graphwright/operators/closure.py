"""Transitive closure of an edge table, what some nodes reach, and nodes on cycles; all safe for cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.sources.scratch import drop, stored, together

#: Steps of a search along edges that make one round, whose result is written.
STEPS = 3


def _steps(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def _apart(df: DataFrame) -> DataFrame:
    """One side of a join of rounds, sorted and merged whatever its size: each broadcast would send it to the driver, and searches have a join or more for every step."""
    return df.hint("merge")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", reflexive: bool = False, most: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst): distinct pairs joined by a path of one edge or more; of none too if `reflexive`.

    Semi-naive: each round joins only the pairs that are farthest apart so far, with all known pairs, and keeps what is new. A shortest path is
    a prefix as long as the longest found so far and a rest that is known, so lengths double, rounds are logarithmic in the depth, and a shortest path is made by its one prefix of that length. `most` bounds
    paths to most + 1 edges; then each round adds one edge. Rounds are written to tables, so that plans stay short and an executor's loss costs a
    round at most. `nodes` (one column) adds nodes without edges to the zero-length pairs. Edges with a null end don't count.
    The result has a row for each pair: where only some nodes matter, use `reached` or `on_cycles`.
    """
    step, *more = closure_rounds(edges, src, dst, most)
    known = together(step, *more)
    known = known.select("src", "dst")
    if reflexive:
        ends = step.select("src").union(step.select("dst"))
        if nodes is not None:
            ends = ends.union(nodes.toDF("src"))
        known = known.union(ends.distinct().select("src", F.col("src").alias("dst"))).distinct()
    return known


def closure_rounds(edges: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> list[DataFrame]:
    """(src, dst, steps) tables: the edges, then the pairs that each round of `closure` adds."""
    step = stored(_steps(edges, src, dst).withColumn("steps", F.lit(1)))
    rounds, delta, length = [step], step, 1
    while most is None or len(rounds) <= most:
        known = together(*rounds)
        onward = (known if most is None else step).select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("steps").alias("rest"))
        new = delta.join(onward, "dst").groupBy("src", F.col("next").alias("dst")).agg(F.min(F.col("steps") + F.col("rest")).alias("steps"))
        new = stored(new.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            drop(new)
            break
        length = 2 * length if most is None else length + 1
        delta = new.where(F.col("steps") == length)
        rounds.append(new)
    return rounds


def reached(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """(node): the seeds (one column) and all that paths of edges from them reach, by at most `most` edges if given.

    Breadth first from the seeds: a round joins only the nodes found in the last one to their edges.
    """
    step = _steps(edges, src, dst)
    known = front = stored(seeds.toDF("node").where("node is not null").distinct())
    turn = 0
    while most is None or turn < most:
        turn += 1
        new = step.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored(new.join(known, "node", "left_anti"))
        if front.isEmpty():
            drop(front)
            break
        known = known.union(front)
    return known


def reached_from(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, node): for each root of the seeds (root, node) its nodes and all that paths of edges from them reach, each once, also where ways meet or run in circles.

    Breadth first for all roots at once; a round joins only the pairs found in the last one.
    """
    step = stored(_steps(edges, src, dst))
    known = front = stored(seeds.toDF("root", "node").where("root is not null and node is not null").distinct())
    while True:
        new = front.withColumnRenamed("node", "src").join(step, "src").select("root", F.col("dst").alias("node")).distinct()
        front = stored(new.join(known, ["root", "node"], "left_anti"))
        if front.isEmpty():
            drop(front, step)
            return known
        known = known.union(front)


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): the nodes that lie on a cycle, loops included."""
    return _ends(cycle_edges(edges, src, dst))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def cycle_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): the edges that lie on a cycle, loops included; each is within one strongly connected part.

    Edges from nodes that nothing leads to, and to nodes that lead nowhere, are peeled off until none is left, which leaves cycles and ways
    between them. If there are as many edges as nodes then, all are on cycles. Else each node gets the least node that reaches it and
    the least that it reaches, edges between nodes whose labels differ go, and so on until none goes: what is left are strongly connected parts.
    """
    rest = stored(_steps(edges, src, dst))
    n = rest.count()
    while n:
        last, before = rest, n
        for _ in range(STEPS):
            rest = rest.join(_apart(rest.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_apart(rest.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst")
        rest = stored(rest)
        n = rest.count()
        drop(last)
        if n == before:
            break
    while n and n != _ends(rest).count():
        ahead, back = _least(rest, "src", "dst"), _least(rest, "dst", "src")
        labels = stored(ahead.join(_apart(back.withColumnRenamed("label", "other")), "node").select("node", F.struct("label", "other").alias("label")))
        cut = rest.join(_apart(labels.select(F.col("node").alias("src"), F.col("label").alias("a"))), "src").join(_apart(labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))), "dst").where("a = b").select("src", "dst")
        last, before, rest = rest, n, stored(cut)
        drop(last, labels, ahead, back)
        n = rest.count()
        if n == before:
            break
    return rest


def shortest_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, n, node): for each strongly connected part with a cycle the shortest one through its least node, from that node (n = 0) back to it.

    A search goes breadth first from all roots at once and keeps each node's least predecessor of those a round earlier; a part is done when its root is met again. The way is then
    rebuilt from its end by joins with the predecessors of each round. Rounds are as many as the longest of the cycles has edges.
    """
    step = cycle_edges(edges, src, dst)
    labels = _least(step, "src", "dst")  # within a part, of all its nodes the least
    roots = labels.where("node = label").select(F.col("node").alias("root"))
    step = stored(step)
    seen = front = stored(roots.select("root", F.col("root").alias("node")))
    open_, levels, closed = stored(roots), [], []
    while True:
        met = step.join(_apart(front.withColumnRenamed("node", "src")), "src").groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        met = stored(met.join(_apart(seen), ["root", "node"], "left_anti").union(met.where("node = root")))
        levels.append(met)
        closed.append(met.where("node = root"))
        open_ = stored(open_.join(_apart(closed[-1].select("root")), "root", "left_anti"))
        if open_.isEmpty():
            break
        front = met.join(_apart(open_), "root", "left_semi").where("node <> root").select("root", "node")
        seen = stored(seen.union(front))
    out, at = [], None
    for n in range(len(levels), 0, -1):
        begin = closed[n - 1].select("root", F.col("root").alias("node"))
        at = begin if at is None else begin.union(at)
        out.append(at.select("root", F.lit(n).alias("n"), "node"))
        at = stored(at.join(_apart(levels[n - 1]), ["root", "node"]).select("root", F.col("before").alias("node")))
    found = at.select("root", F.lit(0).alias("n"), "node")
    for rows in out:
        found = found.union(rows)
    return found


def _least(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label): the least node that reaches each node, itself included."""
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    labels = stored(step.select(F.col("src").alias("node")).union(step.select(F.col("dst").alias("node"))).distinct().withColumn("label", F.col("node")))
    while True:
        new = labels.withColumn("changed", F.lit(False))
        for _ in range(STEPS):
            sent = step.join(_apart(new.select(F.col("node").alias("src"), "label")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
            new = new.join(_apart(sent), "node", "left").select("node", F.least("label", "sent").alias("label"), (F.col("changed") | F.coalesce(F.col("sent") < F.col("label"), F.lit(False))).alias("changed"))
        new = stored(new)
        moved = not new.where("changed").isEmpty()
        drop(labels)
        labels = new.select("node", "label")
        labels.stored_at = new.stored_at
        if not moved:
            return labels


def representatives(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, representative): the least node of the connected part that each node of the edges is in, whatever their direction.

    Stars: each node's neighbours are joined to the least of them, in turn the greater neighbours and the lesser ones, until nothing changes. The
    number of rounds grows with the logarithm of the nodes. Each round is written to a table.
    """
    ends = _steps(edges, src, dst)
    nodes = stored(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct())
    links = stored(ends.where("src <> dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct())
    marks = None
    while True:
        # the greater neighbours of each node get the least one
        near = links.select(F.col("high").alias("node"), F.col("low").alias("other")).union(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = near.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
        grown = near.where("other > node").join(least, "node").select(F.col("other").alias("high"), "low").distinct()
        # then its lesser ones, and itself
        lows = grown.groupBy("high").agg(F.min("low").alias("least"))
        shrunk = grown.join(lows, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).union(lows.select("high", F.col("least").alias("low")))
        last, links = links, stored(shrunk.where("high <> low").distinct())
        drop(last)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")), F.lit(0))).first()
        if now == marks:
            return nodes.join(links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("representative"))
        marks = now
