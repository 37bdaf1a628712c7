"""Removal of byte strings that repeat anywhere in a corpus, by prefix doubling.

A position's rank at length k names the k bytes that start there, so that equal ranks mean
equal strings. Ranks double within a text: the rank at 2k comes from the pair of ranks at k
and at offset k (Karp, Miller and Rosenberg's naming, with 64-bit names instead of dense
numbers, so that texts can be named apart from each other). Spark then orders positions by
rank pairs over all texts in rounds of growing length. After each round positions whose rank
is unique are dropped, for nothing longer that starts there can repeat:

1. rank at 64, one row for each run of starts that share a 64-byte anchor: within every
   string of `length` bytes the least rank of its first grams is chosen, which depends on the
   string alone, so equal strings have equal anchors and a start with a unique anchor is unique.
2. rank of the whole stretch that a run's strings cover, from the pair of ranks at `length` at
   its two ends. A stretch that repeats settles all starts in it at once, so that copies
   and near copies are not dealt with byte by byte.
3. runs whose anchor repeats but whose stretch doesn't, against one of each group of equal stretches, in
   pieces of STEP starts, placed by their distance to the anchor: a piece whose core, the bytes that all its strings
   share, is unique goes; one whose stretch repeats is settled.
4. rank at `length` of single starts, from the pair of ranks at 128 and at the offset that is
   left: for the pieces that remain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.blocks import blocks
from graphwright.sources.scratch import drop, stored

#: Bytes of an anchor, at most; half of a shorter `length`.
GRAM = 64
#: Bytes of text that are named at a time, or one text if that is longer.
BLOCK = 1 << 16
#: Starts of a piece.
STEP = 16
#: In packed places: bits for the number of starts in a run.
RUN_BITS = 16
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _gram(length: int) -> int:
    if length < 4 or length >= 1 << RUN_BITS:
        raise ValueError(f"length must be 4 to {(1 << RUN_BITS) - 1}, not {length}")
    return min(GRAM, 1 << ((length // 2).bit_length() - 1))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names; where b is shorter, 0 stands for the rest."""
    out = a * ODD[0]
    out ^= out >> np.uint64(29)
    out[: len(b)] += b
    return out


def _ranks(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The rank of each position at each of some lengths; those that reach beyond the data mean nothing."""
    k, rank, out = 1, data.astype(np.uint64) + np.uint64(1), {}
    for want in sorted(lengths):
        while 2 * k <= want:
            rank, k = _pair(rank, rank[k:]), 2 * k
        out[want] = _pair(rank, rank[want - k :])
        out[want] *= ODD[1]
        out[want] ^= out[want] >> np.uint64(32)
    return out


def _extreme(a: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or the greatest of each window of so many values, or of as many as there are."""
    out, spare = a.copy(), np.empty_like(a)
    steps = [1 << i for i in range(width.bit_length() - 1)]
    for step in [*steps, width - 2 * steps[-1] if steps else 0]:
        if 0 < step < len(a):
            of(out[:-step], out[step:], out=spare[:-step])
            spare[-step:] = out[-step:]
            out, spare = spare, out
    return out


def runs_of(texts: list[bytes], length: int, stretches: bool) -> dict[str, np.ndarray]:
    """Runs of starts that share an anchor: text (its index), place (first start << RUN_BITS | starts), anchor,
    weight (2 if two of the run's starts may begin equal strings, else 1) and, if asked for, stretch (its name)."""
    gram = _gram(length)
    width = length - gram + 1  # grams in a string
    out: list[list[np.ndarray]] = []
    for lo, hi in blocks(texts, BLOCK):
        sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        long = sizes >= length
        if not long.any():
            continue
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        ranks = _ranks(data, (gram, length) if stretches else (gram,))
        anchor = _extreme(ranks[gram], width, np.minimum)
        steps = np.zeros(len(data) + 1, np.int8)  # texts of at least `length` bytes have starts, so no two steps meet
        steps[begins[long]] = 1
        steps[(ends - length + 1)[long]] -= 1
        valid = np.cumsum(steps[:-1], dtype=np.int8) > 0
        new = np.empty(len(data), bool)
        new[0], new[1:] = True, anchor[1:] != anchor[:-1]
        new[begins[long]] = True
        heads = np.flatnonzero(new & valid)
        cuts = np.append(np.flatnonzero(new | ~valid), len(data))
        tails = cuts[np.searchsorted(cuts, heads, "right")]
        parts = -(-(tails - heads) // width)
        if parts.max() > 1:  # an anchor that recurs soon enough to last: pieces of at most `width` starts
            which = np.repeat(np.arange(len(heads)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            heads, tails = heads[which] + nth * width, np.minimum(heads[which] + (nth + 1) * width, tails[which])
        again = _recurs(ranks[gram], anchor, width, heads, tails)
        text = np.searchsorted(ends, heads, "right")
        columns = [text + lo, (heads - begins[text]) << RUN_BITS | (tails - heads), anchor[heads].view(np.int64), 1 + again]
        if stretches:
            rank = ranks[length]
            columns.append(_pair(_pair(rank[heads], rank[tails - 1]), (tails - heads).astype(np.uint64)).view(np.int64))
        out.append(columns)
    names = ["text", "place", "anchor", "weight", "stretch"][: 4 + stretches]
    return {k: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i, k in enumerate(names)}


def _recurs(rank: np.ndarray, anchor: np.ndarray, width: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """1 where a run's anchor stands at two places or more within the run's windows, else 0."""
    # a place is some window's anchor if its rank is the greatest of the anchors of all windows that hold it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), anchor])
    at = np.flatnonzero(rank == _extreme(padded, width, np.maximum)[: len(rank)])
    order = at[np.argsort(rank[at], kind="stable")]
    ordered, names = rank[order], anchor[heads]
    first, last = np.searchsorted(ordered, names, "left"), np.searchsorted(ordered, names, "right")
    out = np.zeros(len(heads), np.int64)
    for i in np.flatnonzero(last - first > 1):
        places = order[first[i] : last[i]]
        out[i] = np.searchsorted(places, tails[i] - 1 + width, "left") - np.searchsorted(places, heads[i], "left") > 1
    return out


def pieces_of(text: bytes, places: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Pieces of some runs: the run (its index), place, the two ranks whose pair names the core, and the name of the stretch.

    A start's distance is that to the first place of the run's anchor from it on, which its string alone decides.
    """
    gram = _gram(length)
    width, step = length - gram + 1, min(STEP, length - 2)
    core = length - step + 1  # bytes that all strings of a piece share
    half = 1 << (core.bit_length() - 1)
    rank = _ranks(np.frombuffer(text, np.uint8), tuple({gram, half, length}))
    out: list[tuple[np.ndarray, ...]] = []
    for i, place in enumerate(places.tolist()):
        first, n = place >> RUN_BITS, place & ((1 << RUN_BITS) - 1)
        reach = rank[gram][first : first + n - 1 + width]
        anchors = first + np.flatnonzero(reach == reach.min())
        starts = np.arange(first, first + n)
        anchor = anchors[np.searchsorted(anchors, starts)]
        piece = (anchor - starts) // step
        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
        size = np.diff(np.append(head, n))
        at, low = starts[head], (anchor - step * piece)[head]
        form = _pair(_pair(rank[length][at], rank[length][at + size - 1]), ((low - at) << RUN_BITS | size).astype(np.uint64))
        out.append((np.full(len(head), i), at << RUN_BITS | size, rank[half][low].view(np.int64), rank[half][low + core - half].view(np.int64), form.view(np.int64)))
    return {k: np.concatenate([o[j] for o in out]) for j, k in enumerate(("run", "place", "c1", "c2", "form"))}


def starts_of(text: bytes, places: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Single starts of some runs: the run (its index), place, and the two ranks whose pair names the string there."""
    half = 1 << (length.bit_length() - 1)
    rank = _ranks(np.frombuffer(text, np.uint8), (half,))[half]
    n = places & ((1 << RUN_BITS) - 1)
    run = np.repeat(np.arange(len(places)), n)
    start = np.repeat(places >> RUN_BITS, n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return {"run": run, "place": start << RUN_BITS | 1, "h1": rank[start].view(np.int64), "h2": rank[start + length - half].view(np.int64)}


def _covered(size: int, places: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a text belong to strings that begin in some runs."""
    first, n = places >> RUN_BITS, places & ((1 << RUN_BITS) - 1)
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n - 1 + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _map_texts(texts: DataFrame, length: int, stretches: bool) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = runs_of(batch.column("text").to_pylist(), length, stretches)
            columns = {k: pa.array(found[k]) for k in ("anchor", "weight")}
            if stretches:
                columns |= {k: pa.array(found[k]) for k in ("stretch", "place")} | {k: batch.column(k).take(pa.array(found["text"])) for k in ("k1", "k2")}
            yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(batches, "anchor long, weight long" + ", stretch long, place long, k1 long, k2 long" * stretches)


def _map_todo(texts: DataFrame, todo: DataFrame, length: int, pieces: bool) -> DataFrame:
    """Pieces or single starts of runs (k1, k2, place, single), each with its own place, name and `single`."""
    keys = ["k1", "k2"]
    todo = todo.groupBy(*keys).agg(F.collect_list(F.struct("place", "single")).alias("todo"))
    whole = texts.join(todo.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k1, k2, text, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "todo")), strict=True):
                places = np.array([t["place"] for t in runs], np.int64)
                single = np.array([t["single"] for t in runs], bool)
                found = pieces_of(text, places, length) if pieces else starts_of(text, places, length)
                run = found.pop("run")
                yield pa.RecordBatch.from_pydict(found | {"k1": np.full(len(run), k1), "k2": np.full(len(run), k2), "single": single[run]})

    return whole.join(todo, keys).mapInArrow(batches, ("place long, c1 long, c2 long, form long" if pieces else "place long, h1 long, h2 long") + ", k1 long, k2 long, single boolean")


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, places): for each text with strings that start elsewhere too, the runs of their starts.

    texts: (k1, k2, text binary); k1 and k2 name the text, so that equal texts have equal names.
    """
    keys = ["k1", "k2"]
    # round 1: anchors
    anchors = stored(_map_texts(texts, length, False).groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"), release=True)
    runs = stored(_map_texts(texts, length, True).join(anchors, "anchor", "left_semi"), release=True)
    drop(anchors)
    # round 2: stretches
    classes = stored(runs.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.min(F.struct(*keys, "place")).alias("one")), release=True)
    settled = stored(runs.join(classes.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").groupBy(*keys).agg(F.collect_set("place").alias("places")), release=True)
    drop(runs)
    # round 3: pieces of runs whose anchor has several stretches
    mixed = stored(classes.groupBy("anchor").agg(F.sum("weight").alias("forms")).where("forms > 1").select("anchor"))
    todo = classes.join(mixed, "anchor", "left_semi").select("one.*", (F.col("n") == 1).alias("single"))
    pieces = stored(_map_todo(texts, todo, length, True), release=True)
    drop(classes, mixed)
    forms = stored(pieces.groupBy("c1", "c2", "form").agg(F.count("*").alias("n"), F.max("single").alias("single"), F.min(F.struct(*keys, "place")).alias("one")), release=True)
    whole = pieces.where("single").join(forms.where("n > 1 and single").select("c1", "c2", "form"), ["c1", "c2", "form"], "left_semi").select(*keys, "place")
    # round 4: single starts of pieces whose core has several forms, one of them not settled
    mixed = stored(forms.groupBy("c1", "c2").agg(F.count("*").alias("forms"), F.max(F.col("single") & (F.col("n") == 1)).alias("open")).where("forms > 1 and open").select("c1", "c2"))
    todo = forms.join(mixed, ["c1", "c2"], "left_semi").select("one.*", (F.col("single") & (F.col("n") == 1)).alias("single"))
    starts = stored(_map_todo(texts, todo, length, False), release=True)
    again = stored(starts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("single").alias("single")).where("n > 1 and single").select("h1", "h2"))
    found = starts.where("single").join(again, ["h1", "h2"], "left_semi").select(*keys, "place")
    every = settled.withColumn("place", F.explode("places")).select(*keys, "place").union(whole).union(found)
    out = stored(every.groupBy(*keys).agg(F.collect_set("place").alias("places")), release=True)
    drop(settled, pieces, forms, mixed, starts, again)
    return out


def without_repeats(docs: DataFrame, text_column: str = "text", length: int = 200, out: str = "repeats", whole_characters: bool = False) -> DataFrame:
    """`docs` with a column struct<n_bytes bigint, n_removed bigint, n_spans bigint, kept binary>.

    Texts are UTF-8 bytes. Removed is each byte covered by a string of `length` bytes that also
    starts anywhere else, in the same text or another one; strings overlap and are judged on the
    input. kept: the remaining bytes; with whole_characters characters that are covered in part
    only stay (and count as kept). n_spans: maximal runs of removed bytes.

    Null texts are empty. Texts shorter than `length` stay as they are. Repeated rows are copies of
    each other, and lose everything from `length` bytes on. Texts are read whole, however long. Other columns, whatever their
    names, pass through; `out` replaces one of its name.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text")).select("row", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(length), "text").alias("k2"))
    found = repeated_runs(rows.where(F.length("text") >= length).select("k1", "k2", "text"), length)

    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def batches(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in columns:
            out = []
            for t, runs in zip(texts.to_pylist(), places.to_pylist(), strict=True):
                if not runs:
                    out.append((len(t), 0, 0, t))
                    continue
                data = np.frombuffer(t, np.uint8)
                gone = _covered(len(t), np.array(runs, np.int64), length)
                if whole_characters:
                    head = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(data))))
                spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
                out.append((len(t), int(np.count_nonzero(gone)), int(spans), data[~gone].tobytes()))
            yield pa.StructArray.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(kind)], fields=list(kind))

    batches.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    removed: Column = F.arrow_udf(batches, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")("text", "places")
    return rows.join(found, ["k1", "k2"], "left").select("row", removed.alias("removed")).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != out], F.col("removed").alias(out))
