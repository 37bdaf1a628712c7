"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

The statistics of a bounded sample of labelled documents go to the driver, where the trees
are grown; they are then flattened into arrays and sent with the scoring function, which walks all
trees for a batch of documents at once. Scoring shuffles nothing.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents to learn from, at most.
SAMPLE = 20_000
BINS = 64

# Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|",
    "mark": b"#$%&*+<=>@^_~\\/",
    "bracket": b"()[]{}\"'`",
}
STATISTICS = [*CLASSES, "wide", "log_bytes", "log_words", "word_bytes", "distinct_words", "same_next", "capital_words", "line_words", "distinct_lines"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text; all are 0 for a null or empty text."""
    table = np.full(256, len(CLASSES) + 1, np.uint8)
    table[128:] = len(CLASSES)
    for i, chars in enumerate(CLASSES.values()):
        table[np.frombuffer(chars, np.uint8)] = i
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        row[: len(CLASSES) + 1] = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 2)[: len(CLASSES) + 1] / len(raw)
        words, lines = raw.split(), raw.split(b"\n")
        n = max(len(words), 1)
        capital = sum(map(bytes.isupper, words))
        row[len(CLASSES) + 1 :] = np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, capital / n, len(words) / len(lines), len(set(lines)) / len(lines)
    return out


@dataclass
class Trees:
    """Trees as arrays over all nodes: a leaf's children are itself, so that every walk takes `depth` steps."""

    start: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        if not len(rows):
            return np.zeros(0)
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        which = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = np.where(rows[which, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 5, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss. With no rows, or labels all alike, a constant near their share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0) for f in range(rows.shape[1])]
    bins = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(rows) else rows.astype(int)
    flat = bins + BINS * np.arange(rows.shape[1])
    raw = np.full(len(rows), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = labels - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        todo = [(roots[-1], np.arange(len(rows)), 0)]
        while todo:
            at, members, level = todo.pop()
            g, h = slope[members].sum(), curve[members].sum()
            nodes[at][4] = step = rate * g / (h + ridge)
            best = None
            if level < depth and len(members) >= 2 * least:
                cells, size = flat[members].ravel(), BINS * rows.shape[1]
                wide = rows.shape[1]
                gs, hs, ns = (np.bincount(cells, w, size).reshape(wide, BINS).cumsum(axis=1)[:, :-1] for w in (np.repeat(slope[members], wide), np.repeat(curve[members], wide), np.ones(len(cells))))
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(ns < least) | (len(members) - ns < least)] = -1
                best = np.unravel_index(gain.argmax(), gain.shape)
                if gain[best] <= 1e-9:
                    best = None
            if best is None:
                raw[members] += step
                continue
            f, b = map(int, best)
            goes = bins[members, f] <= b
            low, high = len(nodes), len(nodes) + 1
            nodes[at][:4] = f, edges[f][b], low, high
            nodes += [[0, 0.0, low, low, 0.0], [0, 0.0, high, high, 0.0]]
            todo += [(low, members[goes], level + 1), (high, members[~goes], level + 1)]
    columns = np.array(nodes, float).reshape(-1, 5).T
    return Trees(start, depth, np.array(roots, np.int64), columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4])


def learn(sample: DataFrame, **how) -> Trees:
    """Trees from (id, text, label); their statistics, at most SAMPLE short rows, are collected."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = statistics(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "found": pa.array(found.tolist(), pa.list_(pa.float64()))})

    rows = sample.mapInArrow(batches, f"id {sample.schema['id'].dataType.simpleString()}, label int, found array<double>").toPandas().sort_values("id", kind="stable")
    return grow(np.array(rows["found"].tolist(), float).reshape(-1, len(STATISTICS)), rows["label"].to_numpy(float), **how)


def score(text: Column, trees: Trees) -> Column:
    """The probability of good quality for a text column; null texts are scored as empty ones."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(trees.scores(statistics(column.to_pylist())))

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "double")(text)
