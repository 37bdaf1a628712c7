"""A toxicity classifier: FTRL-proximal logistic regression over hashed words, word pairs and skip-pairs.

Features are the words of a text, the stems of its longer words (their first 4 to 8 letters), pairs of
neighbouring words and pairs with one word between them, each hashed to a place below
2**HASH_BITS and counted once a text. Per-coordinate rates and L1 keep few weights above zero;
they are one compact row, at most 2**HASH_BITS weights, sent with the scoring function.
Learning sees a bounded sample in one task. Scoring shuffles nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.blocks import blocks

#: Characters of text to make features of at a time.
BLOCK = 1 << 20
#: Labelled documents to learn from, at most.
SAMPLE = 16_000
HASH_BITS = 20
STEMS = (4, 5, 6, 7, 8)
#: The bias where there is nothing to learn from.
NOTHING_LEARNED = -10.0
WORD = re.compile(r"[^\W\d_]+")
#: Words remembered with their hashes, per worker; a table this full starts anew with the next batch.
REMEMBERED = 300_000


class _Hashes(dict):
    """The row of a word in `table`: its hash, and those of its stems (0 where a word is no longer than a stem)."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, ...]] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self.rows)
        self.rows.append((xxhash.xxh32_intdigest(word, 1), *(xxhash.xxh32_intdigest(word[:n], n) | 1 if len(word) > n else 0 for n in STEMS)))
        return row

    def of(self, found: list[list[str]], size: int) -> np.ndarray:
        """A row of hashes for each of `size` words."""
        if len(self) >= REMEMBERED:
            self.clear()
            self.rows.clear()
        rows = np.fromiter((row for words in found for row in map(self.__getitem__, words)), np.int64, size)
        return np.array(self.rows, np.uint64).reshape(-1, 1 + len(STEMS))[rows]


@functools.cache
def _hashes() -> _Hashes:
    return _Hashes()


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out >> np.uint64(64 - HASH_BITS)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The text (its index) and the place of each feature, with repeats; null texts have none."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    hashes = _hashes().of(found, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    word, zero = hashes[:, 0], np.zeros(1, np.uint64)
    near, far = text[1:] == text[:-1], text[2:] == text[:-2]
    parts = [(text, _mixed(word, zero, 1)), (text[1:][near], _mixed(word[:-1][near], word[1:][near], 2)), (text[2:][far], _mixed(word[:-2][far], word[2:][far], 3))]
    for k in range(1, 1 + len(STEMS)):
        stemmed = hashes[:, k] > 0
        parts.append((text[stemmed], _mixed(hashes[stemmed, k], zero, 3 + k)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Dense weights, mostly zero, and the bias. rows: distinct places of each text. Rows are taken in a fixed shuffled order."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, which has no L1

    def weights(at: np.ndarray) -> np.ndarray:
        limit = np.where(at == size, 0.0, l1)
        return np.where(np.abs(z[at]) <= limit, 0.0, -(z[at] - np.sign(z[at]) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rows = [np.append(r, size) for r in rows]
    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def learn(sample: DataFrame, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights, where not zero, and the bias, from (id, text, label).

    FTRL takes one text after the other, so one task learns, from at most SAMPLE rows in the
    order of their ids. Without rows nothing is toxic.
    """

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            ordered = np.concatenate([np.unique((own + lo) << HASH_BITS | place) for lo, hi in blocks(texts, BLOCK) for own, place in [features(texts[lo:hi])]])
            cuts = np.searchsorted(ordered, np.arange(batch.num_rows + 1) << HASH_BITS)
            places = (ordered & ((1 << HASH_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "places": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places))})

    def learned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, places = [], [], []
        for batch in rows:
            ids += batch.column("id").to_pylist()
            labels += batch.column("label").to_pylist()
            places += [p.values.to_numpy() for p in batch.column("places")]
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        w, bias = ftrl([places[i] for i in order], np.array([labels[i] for i in order], float), **how)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"place": pa.array([at.astype("<i4").tobytes()], pa.binary()), "weight": pa.array([w[at].astype("<f4").tobytes()], pa.binary()), "bias": [bias]})

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(made, f"id {kind}, label int, places array<int>").repartition(1).mapInArrow(learned, "place binary, weight binary, bias double").collect()
    if not rows:  # no task had any
        return np.zeros(0, np.int32), np.zeros(0, np.float32), NOTHING_LEARNED
    return np.frombuffer(rows[0].place, "<i4"), np.frombuffer(rows[0].weight, "<f4"), rows[0].bias


def score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The probability that a text is toxic; null and empty texts get the bias alone."""
    at, weight, bias = model

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[at] = weight
        for column in texts:
            texts, total = column.to_pylist(), np.full(len(column), bias)
            for lo, hi in blocks(texts, BLOCK):
                owner, place = features(texts[lo:hi])
                some = dense[place] != 0
                pairs = np.unique(owner[some] << HASH_BITS | place[some])
                total[lo:hi] += np.bincount(pairs >> HASH_BITS, dense[pairs & ((1 << HASH_BITS) - 1)], hi - lo)
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "double")(text)
