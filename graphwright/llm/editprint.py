"""Document fingerprints by randomised edit embedding (Chakraborty, Goldenberg and Koucký, 2016).

Two texts walk through the same random choices: at each step a text shows its present character
and goes on to the next one if the choice for this step and character says so. Few edits then
leave most steps alike, so edit distance becomes Hamming distance between what is shown. The
fingerprint samples SLOTS steps of each of WALKS independent walks, since one walk may lose its way for long after an edit, and keeps a bit of
each character shown; two fingerprints are as alike as their most alike walks. A slot's step depends on the text's length only, and is spread evenly over the walk: of a series of steps, shared by
all texts, in which each is a uniformly chosen fraction of the next, the last one within the length counts;
texts of nearly the same length therefore sample the same steps.

`near_groups` finds alike fingerprints by bands of sampled bits and verifies them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from graphwright.llm.blocks import blocks, spans
from graphwright.llm.linking import linked_groups
from graphwright.sources.scratch import drop, stored

WALKS = 2
#: Sampled steps of a walk, one bit each; a multiple of 64.
SLOTS = 512
SEED = 20160619
#: Expected steps for a character.
PACE = 2
#: Steps between looks at which walks have ended, and steps of choices made together.
STRIDE = 256
#: Bits of a band: so many that unlike texts hardly ever share one, in a billion too.
BAND_BITS = 32
#: Characters that walk together, or one text if that is longer; it bounds memory at some bytes for each.
BLOCK = 1 << 25
#: Bytes of rows that are compared together; their edited texts come on top.
ROWS = 1 << 22
LAST = 1 << 40


@functools.cache
def _samples(walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by step: the step, its slot, the slot's next step; and a bit for each slot and character class."""
    random = np.random.default_rng((SEED, walk))
    found: list[tuple[int, int, int]] = []
    for slot in range(SLOTS):
        step = 1
        while step < LAST:
            after = min(int(step / random.uniform(1e-9, 1)) + 1, LAST)
            found.append((step, slot, after))
            step = after
    bits = random.integers(0, 2, (SLOTS, 256), np.uint8)
    steps, slots, after = np.array(sorted(found), np.int64).T
    return steps, slots, after, bits


@functools.lru_cache(1024)
def _choices(walk: int, stride: int) -> np.ndarray:
    """Whether to go on, for each step of a stride and character class; never from the end, class 0."""
    out = np.random.default_rng((SEED, walk, stride)).integers(0, 2, (STRIDE, 256), np.uint8)
    out[:, 0] = 0
    return out


def _classes(text: str) -> np.ndarray:
    """A class from 1 to 255 for each character."""
    try:
        codes = np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.uint16)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (codes % 255 + 1).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """WALKS * SLOTS bits, packed, for each text."""
    out = np.zeros((len(texts), WALKS, SLOTS // 8), np.uint8)
    for lo, hi in blocks(texts, BLOCK):
        for walk in range(WALKS):
            out[lo:hi, walk] = _walk(texts[lo:hi], walk)
    return out.reshape(len(texts), -1)


def _walk(texts: list[str], walk: int) -> np.ndarray:
    steps, slots, after, bits = _samples(walk)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    shown = np.zeros((SLOTS, len(texts)), np.uint8)  # longest text first; 0 where a walk has ended before
    reach = np.maximum(PACE * sizes[order], 1)
    ends = np.cumsum(sizes[order] + 1)
    classes = np.zeros(int(ends[-1]) if len(texts) else 0, np.uint8)
    for i, end in zip(order, ends, strict=True):
        classes[end - 1 - sizes[i] : end - 1] = _classes(texts[i])
    at, who = ends - 1 - sizes[order], np.arange(len(texts))
    next_sample = np.searchsorted(steps, 0)
    # a walk ends with its text; its places from then on are those of the end
    for stride in range(-(-int(reach.max(initial=0)) // STRIDE)):
        on = classes[at] > 0
        if not on.all():
            at, who = at[on], who[on]
        if not len(at):
            break
        choices, reached = _choices(walk, stride), reach[who]
        for step in range(stride * STRIDE + 1, (stride + 1) * STRIDE + 1):
            now = classes[at]
            while next_sample < len(steps) and steps[next_sample] == step:
                # texts that reach this step but not the slot's next one; reach falls
                a = len(who) - np.searchsorted(reached[::-1], after[next_sample], "left")
                b = len(who) - np.searchsorted(reached[::-1], step, "left")
                shown[slots[next_sample], who[a:b]] = now[a:b]
                next_sample += 1
            at += choices[step - 1 - stride * STRIDE][now]
    out = np.empty((len(texts), SLOTS // 8), np.uint8)
    out[order] = np.packbits(bits[np.arange(SLOTS)[:, None], shown], axis=0).T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 for those no more alike than chance makes them, from packed bits; that of the walk in which they are most alike."""
    other = np.bitwise_count(a ^ b).reshape(len(a), WALKS, -1).sum(axis=2, dtype=np.int64).min(axis=1, initial=SLOTS)
    return np.maximum(0.0, 1 - 2 * other / SLOTS)


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_together: int = 5_000) -> DataFrame:
    """(id, text, next_text): the text of the next row in order of (id, text), after the last that of the first.

    Null texts are empty; null ids come first and make one range. Rows are dealt by ranges of ids of about `rows_together` rows; ids are numbers.
    Each range also gets the first row of the range that follows. What goes to the driver is the bounds and first ids of ranges.
    Rows with one id stand in one range, and follow each other in order of their texts. Other columns aren't looked at. Ids of another type are an error (TypeError).
    """
    if not isinstance(docs.schema[id_column].dataType, NumericType):
        raise TypeError(f"{id_column} has no numbers")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    ranges = -(-rows.count() // rows_together) or 1
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("id", shares, max(10_000, 2 * ranges)).alias("cuts")).first().cuts if shares else []
    bounds = np.array(sorted(set(cuts or [])))

    def dealt(column: pa.Array) -> pa.Array:
        ids = column.to_numpy(zero_copy_only=False)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(np.where(known, np.searchsorted(bounds, np.where(known, ids, 0), "left"), 0).astype(np.int32))

    dealt.__annotations__ = {"column": pa.Array, "return": pa.Array}
    dealt = F.arrow_udf(dealt, "int")
    firsts = sorted(rows.groupBy(dealt("id").alias("part")).agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null")).collect())
    if not firsts:
        return rows.withColumn("next_text", F.lit(""))
    heads = [None if f.null else f.id for f in firsts]
    kind = rows.schema["id"].dataType.simpleString()
    follows = rows.sparkSession.createDataFrame([(head, firsts[i - 1].part) for i, head in enumerate(heads)], f"id {kind}, part int")
    guests = rows.join(F.broadcast(follows.withColumnRenamed("id", "head")), F.col("id").eqNullSafe(F.col("head"))).select("id", "text", "part", F.lit(True).alias("guest"))
    everyone = rows.select("id", "text", dealt("id").alias("part"), F.lit(False).alias("guest")).union(guests)
    window = Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    return everyone.withColumn("next_text", F.lead("text").over(window)).where("not guest").select("id", "text", "next_text")


def edited(text: str, after: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_text(text: Column, after: Column) -> Column:
    """`edited` for columns without nulls."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(after, F.lit(1), half))


def _bytes(prints: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in prints], pa.binary())


def compare(text: Column, next_text: Column) -> Column:
    """struct<fingerprint, edited_fingerprint, near_edited, near_next> of a text and the one after it.

    Null texts are empty. The edited text is `edited(text, next_text)`, fingerprints are packed bits, and near_*
    are likenesses of the text's fingerprint to the edited text's and to the next one's.
    """
    kind = pa.struct([("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batches(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for both in columns:
            parts: list[pa.Array] = []
            sizes = np.maximum(pc.binary_length(both[0]).fill_null(0).to_numpy(zero_copy_only=False), pc.binary_length(both[1]).fill_null(0).to_numpy(zero_copy_only=False))
            for lo, hi in spans(sizes, ROWS):
                texts, following = ([t or "" for t in c.slice(lo, hi - lo).to_pylist()] for c in both)
                changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
                places: dict[str, int] = {}
                rows = [np.array([places.setdefault(t, len(places)) for t in some], np.int64) for some in (texts, changed, following)]
                own, other, after = map(fingerprints(list(places)).__getitem__, rows)
                parts.append(pa.StructArray.from_arrays([_bytes(own), _bytes(other), pa.array(likeness(own, other)), pa.array(likeness(own, after))], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    batches.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")(text, next_text)


def bands_for(least: float, miss: float, band_bits: int = BAND_BITS) -> int:
    """So many bands that two fingerprints whose walks are `least` alike share none with a chance of `miss`."""
    agree = ((1 + least) / 2) ** band_bits
    return math.ceil(math.log(miss) / math.log1p(-agree)) if agree < 1 else 1


def near_groups(prints: DataFrame, least: float = 0.9, miss: float = 0.01, id_column: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """`prints` with a column group_id, which replaces one of its name: the smallest id that links between alike fingerprints (binary) reach, its own included.

    Two fingerprints are linked if their likeness is at least `least` and they share a band: BAND_BITS bits of one walk, sampled at random. There are so many
    bands a walk that a pair at `least` is missed with a chance of `miss`, and one more alike less often. Fingerprints are made distinct before
    bands are joined, and named by 64-bit hashes, so copies add nothing; candidates are verified by their bits within the join. Null fingerprints link
    to nothing and have no group; null ids are never smallest. No rows give no rows.
    """
    random = np.random.default_rng(SEED + 1)
    places = np.stack([walk * SLOTS + random.choice(SLOTS, BAND_BITS, replace=False) for walk in range(WALKS) for _ in range(bands_for(least, miss))])
    weights = np.uint64(1) << np.arange(BAND_BITS, dtype=np.uint64)
    kind = pa.struct([("words", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def cut(column: pa.Array) -> pa.Array:
        packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WALKS * SLOTS // 8)
        bits = np.unpackbits(packed, axis=1)
        keys = np.stack([bits[:, p] @ weights | np.uint64(band << BAND_BITS) for band, p in enumerate(places)], axis=1).astype(np.int64)
        lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (packed.view(np.int64), keys)]
        return pa.StructArray.from_arrays(lists, fields=list(kind))

    def alike(a: str, b: str) -> Column:
        other = [F.bit_count(F.col(f"{a}_words")[i].bitwiseXOR(F.col(f"{b}_words")[i])) for i in range(WALKS * SLOTS // 64)]
        walks = [sum(other[w * SLOTS // 64 : (w + 1) * SLOTS // 64], F.lit(0)) for w in range(WALKS)]
        return F.least(*walks) <= int((1 - least) / 2 * SLOTS + 1e-9)

    cut.__annotations__ = {"column": pa.Array, "return": pa.Array}
    kept = [F.col(f"`{c}`") for c in prints.columns if c != "group_id"]
    rows = prints.select(F.struct(*kept).alias("row"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("print"))
    rows = rows.withColumn("node", F.when(F.col("print").isNotNull(), F.xxhash64("print")))
    distinct = rows.where("print is not null").groupBy("node").agg(F.first("print").alias("print"))
    nodes = stored(distinct.select("node", F.arrow_udf(cut, "words array<bigint>, keys array<bigint>")("print").alias("c")).select("node", "c.*"), release=True)
    groups = linked_groups(nodes, ["words"], alike)
    drop(nodes)
    named = rows.join(groups, "node", "left").select("row", "id", F.coalesce("component", "node").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("id").alias("group_id")), "component", "left").select("row.*", "group_id")
