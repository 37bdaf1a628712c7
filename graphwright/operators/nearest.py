"""Nearest neighbours of many vectors at once, by an inverted file of cells.

Centres are fitted on a bounded sample. Every vector is filed under its nearest centre, and under the next nearest too where that is nearly as
close. A query looks into the cells whose centres are nearest to it and ranks what it finds by its exact cosine; looking into all
cells is the exact search. A cell's vectors and its queries are dealt over as many shares as their numbers ask for, so a task compares
at most some SHARE vectors with SHARE queries, however many a cell has, and holds SCORES of their scores at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.sources.scratch import stored

#: Vectors that centres are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 10
#: A vector whose cosine with the second centre is within this of that with the first is filed under both.
CLOSE = 0.1
#: Vectors, and queries, of a cell that go to one task.
SHARE = 20_000
#: Queries that a task compares at a time, and scores that it holds of them: fewer queries where a share has many vectors.
BLOCK, SCORES = 250, 500_000
#: Places that scores are rounded to before they are ranked, so that equal vectors tie.
PLACES = 9


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit_cells(vectors: DataFrame, cells: int, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres, at most `cells`: spherical k-means of the `sample` vectors whose ids hash lowest, of the commonest length among them.

    The sample is all that reaches the driver. It starts from vectors far apart, so that rare directions have centres.
    """
    rows = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    some = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect() if None not in r.v]
    if not some:
        return np.zeros((0, 0))
    sizes = pd.Series([len(v) for v in some]).value_counts()
    size = min(n for n in sizes.index if sizes[n] == sizes.max())
    at = _unit(np.array([v for v in some if len(v) == size]))
    chosen, nearest = [0], at @ at[0]
    while len(chosen) < min(cells, len(at)):
        furthest = int(np.argmin(nearest))
        if nearest[furthest] > 1 - 1e-9:
            break
        chosen.append(furthest)
        nearest = np.maximum(nearest, at @ at[furthest])
    centres = at[chosen]
    for _ in range(rounds):
        of = np.argmax(at @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, at)
        empty = ~sums.any(axis=1)
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def _nearest_cells(vector: Column, centres: np.ndarray, most: int, close: float | None = None) -> Column:
    """The cells of the `most` nearest centres, nearest first; with `close`, those within it of the nearest."""

    def batch(values: pd.Series) -> pd.Series:
        scores = _unit(np.array(values.tolist(), dtype=np.float64)) @ centres.T if len(values) else np.zeros((0, len(centres)))
        order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        if close is None:
            return pd.Series(list(order.astype(np.int32)))
        best = np.take_along_axis(scores, order, axis=1)
        return pd.Series([o[b >= b[0] - close].astype(np.int32) for o, b in zip(order, best, strict=True)])

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<int>")(vector)


def _usable(vectors: DataFrame, size: int, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    return vectors.where(F.col(vector_column).isNotNull() & (F.size(vector_column) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(F.col(id_column).alias("id"), v.alias("v"))


def file_vectors(vectors: DataFrame, centres: np.ndarray, id_column: str = "vec_id", vector_column: str = "embedding", close: float = CLOSE) -> DataFrame:
    """(cell, share, id, v): every vector of the centres' length under its cell, and under a second one where that is `close`. Others can't be compared and are left out."""
    rows = _usable(vectors, centres.shape[1] if len(centres) else -1, id_column, vector_column)
    if not len(centres):
        return rows.where("false").select(F.lit(0).alias("cell"), F.lit(0).alias("share"), "id", "v")
    filed = rows.withColumn("cell", F.explode(_nearest_cells(F.col("v"), centres, 2, close)))
    sizes = filed.groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell: bounded by the number of centres
    shares = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")))
    return filed.join(shares, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "v")


def store_cells(filed: DataFrame, path: str) -> None:
    """Filed vectors as Parquet, a folder a cell and a file or more a share; a search reads the folders of the cells it looks into."""
    filed.repartition("cell", "share").write.partitionBy("cell").parquet(path)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, none of them or of their numbers null, as rows; not copied where they are in one batch."""
    return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)


def _compared(k: int):
    """Ranks the queries of a share of a cell against its vectors: the k best of each, those of equal id left out."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids, rows = [], [], []
        if left.num_rows and right.num_rows:
            own, other = left.column("id").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(own, kind="stable")
            at, own = _unit(_matrix(left.column("v"))[order]), own[order]
            asked, block = _matrix(right.column("v")), max(min(BLOCK, SCORES // len(at)), 1)
            for start in range(0, len(asked), block):
                scores = _unit(asked[start : start + block]) @ at.T
                np.round(scores, PLACES, out=scores)
                scores[other[start : start + block, None] == own[None, :]] = -np.inf
                n = min(k, scores.shape[1])
                least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                q, v = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                # of equal scores those of the least ids: rows are in the order of ids
                best = np.lexsort((v, -scores[q, v], q))
                q, v = q[best], v[best]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, v = q[place < k], v[place < k]
                queries.append(other[start + q])
                ids.append(own[v])
                rows.append(scores[q, v])
        kind = left.schema.field("id").type
        return pa.table({"query": pa.array(np.concatenate(queries) if queries else [], kind), "id": pa.array(np.concatenate(ids) if ids else [], kind), "score": pa.array(np.concatenate(rows) if rows else [], pa.float64())})

    compare.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return compare


def neighbours(filed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query, rank, id, score): for each query its k nearest filed vectors of other ids by cosine, from the `probes` cells nearest to it; from all cells without it, which is exact.

    Scores are rounded to PLACES; equal ones rank by id. A zero vector has a cosine of 0 with all. Queries with a null id, or whose vector is null or of another length, have no rows.
    """
    kind = filed.schema["id"].dataType.simpleString()
    if not len(centres):
        return filed.sparkSession.createDataFrame([], f"query {kind}, rank int, id {kind}, score double")
    asked = _usable(queries, centres.shape[1], id_column, vector_column).where("id is not null").dropDuplicates(["id"])
    cells = F.sequence(F.lit(0), F.lit(len(centres) - 1)) if probes is None else _nearest_cells(F.col("v"), centres, min(probes, len(centres)))
    asked = asked.withColumn("cell", F.explode(cells))
    held = filed.where("id is not null")
    shares = held.groupBy("cell").agg((F.max("share") + 1).alias("shares"))
    turns = asked.groupBy("cell").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("turns"))
    # a row a cell
    plan = stored(shares.join(turns, "cell"))
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.join(F.broadcast(plan), "cell").select("cell", "share", count("turns").alias("turn"), "id", "v")
    right = asked.join(F.broadcast(plan), "cell").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int")).select("cell", count("shares").alias("share"), "turn", "id", "v")
    key = ["cell", "share", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compared(k), f"query {kind}, id {kind}, score double")
    # a vector filed twice may be found twice
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
