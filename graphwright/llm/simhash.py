"""SimHash near-duplicates: fingerprints of word shingles and the groups that they link; and groups of texts by exact shingle similarity.

Candidates come from deletion-variant signatures. For a distance of d, a fingerprint is cut
into ceil((d + 1) / 2) segments, so that two fingerprints within d have a segment that differs
in one bit at most. Each segment is indexed once for each of its bits, with that bit
masked; equal signatures are joined and verified in the join itself, so that only true links
leave it, each from one signature.

`keep_one`, for the pipeline, asks for a similarity of shingle sets. It takes candidates from SimHash signatures, adds those that 64 bits
can't propose from MinHash bands, and verifies all of them on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.components import components
from graphwright.llm.linking import linked_groups
from graphwright.sources.scratch import drop, stored

BITS = 64
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: MinHash bands and the minima in each, for `keep_one`; two texts of similarity s share a band with a chance of 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 25, 5
#: Minima of which a sketch keeps two bits each; a multiple of 64. The first BANDS * ROWS make the bands.
MINIMA = 512
#: Places of a shingle set's parities; a multiple of 64.
PLACES = 1024
#: Bytes of texts and shingle sets that a task remembers.
REMEMBERED = 1 << 25
#: Odd multipliers; the products with one of them order hashes at random, those with another mix a minimum's bits.
ORDERS, MIXERS = np.random.default_rng(42).integers(2**32, size=(2, MINIMA), dtype=np.uint32) | np.uint32(1)


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each run of so many words, repeats included; of the whole sequence if there are fewer words; none of no words."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends.tolist()]
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[min(words, len(found)) :], strict=False)]


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of some 64-bit hashes."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(texts: list[str | None], words: int, seed: int) -> np.ndarray:
    """A row for each text, one column: the fingerprint of its shingles, repeats included."""
    out = np.zeros((len(texts), 1), np.uint64)
    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, words, seed):
            out[i] = _majority(np.array(hashes, np.uint64))
    return out


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """The SimHash (bigint, to be read as 64 bits) of a text column's word shingles.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A bit is 1 if
    it is set in over half of the shingles' XXH64. Null, empty and blank texts have 0.
    """

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(_fingerprints(column.to_pylist(), words, seed)[:, 0].view(np.int64))

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "bigint")(text)


def _segments(distance: int) -> list[tuple[int, int, int]]:
    """(mask, lowest bit, highest bit) of each segment, the mask as a signed number."""
    n = (distance + 2) // 2
    edges = [BITS * i // n for i in range(n + 1)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [(signed(((1 << (hi - lo)) - 1) << lo), lo, hi - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signatures(prints: DataFrame, distance: int) -> DataFrame:
    """The rows of `prints`, once for each bit, with `bit` and the `signature` that masks it within its segment of `fp`."""
    segments = F.array(*[F.struct(F.lit(mask).alias("mask"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for mask, lo, hi in _segments(distance)])
    cut = prints.select("*", F.explode(segments).alias("s")).select(*prints.columns, "s.*").select(*prints.columns, "mask", F.explode(F.sequence("low", "high")).alias("bit"))
    one = F.expr("shiftleft(1L, bit)")
    return cut.select(*prints.columns, F.col("bit").cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not(one)).alias("signature"))


def _first(differ: Column, distance: int) -> Column:
    """The bit of the one signature that gives a pair: of the first segment with at most one differing bit, that bit or the segment's lowest."""
    first = F.lit(None).cast("int")
    for mask, lo, _ in reversed(_segments(distance)):
        part = differ.bitwiseAND(F.lit(mask))
        place = F.when(part == 0, F.lit(lo)).when(part < 0, F.lit(BITS - 1)).otherwise(F.bit_count(part - 1).cast("int"))
        first = F.when(F.bit_count(part) <= 1, place).otherwise(first)
    return first


def links(prints: DataFrame, distance: int = 3, column: str = "fp") -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of a bigint column that differ in 1 to `distance` bits.

    Fingerprints are made distinct first, so copies cost nothing, and one of them has links to at most the C(64, 1) + ... + C(64, distance)
    values around it (43,744 for 3), whatever the input. Null fingerprints link to nothing.
    """
    index = _signatures(prints.select(F.col(column).alias("fp")).where(F.col(column).isNotNull()).distinct(), distance)
    left, right = (index.select(F.col("fp").alias(x), "bit", "signature") for x in "ab")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # Spark sizes an exploded table as if each row gave one, and would broadcast 64 rows for each fingerprint; a sort and merge doesn't pass the driver
    found = left.join(right.hint("merge"), ["bit", "signature"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & (F.col("bit") == _first(differ, distance)))
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row: its fingerprint and the smallest id that its links reach, its own included.

    Rows of one fingerprint are linked; so are fingerprints within `distance` bits. Null ids are
    kept and never smallest; a group of null ids alone has a null component. Other columns of
    `docs` aren't looked at. No rows give no rows.
    """
    prints = stored(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column), words, seed).alias("fp")))
    linked = stored(links(prints, distance), release=True)
    groups = components(linked)
    drop(linked)
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "component").join(first, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets that aren't both empty."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _minima(hashes: np.ndarray) -> np.ndarray:
    """MinHash: the least product of the hashes' upper halves with each of ORDERS, modulo 2**32."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    out, products = np.full(MINIMA, 2**32 - 1, np.uint32), np.empty((128, MINIMA), np.uint32)
    for i in range(0, len(upper), 128):
        some = upper[i : i + 128]
        np.minimum(out, np.multiply(some[:, None], ORDERS, out=products[: len(some)]).min(axis=0), out=out)
    return out


def _sketch(minima: np.ndarray) -> np.ndarray:
    """Two mixed bits of each minimum, as 64-bit numbers: first one bit of all of them, then the other."""
    mixed = minima * MIXERS
    return np.packbits(np.stack([mixed >> np.uint32(31), mixed >> np.uint32(30) & np.uint32(1)]).astype(np.uint8)).view(np.int64)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of PLACES, dealt by the lowest bits, has an odd number of the hashes, as 64-bit numbers. Sets that differ in d hashes have at most d places unlike."""
    counts = np.bincount((hashes & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _described(text: Column, words: int, seed: int) -> Column:
    """struct<node, n, fp, keys, sketch, parities>: XXH64 of a text's shingle set, the set's size and SimHash, a key for each MinHash band, bits of the minima, and the set's parities."""
    longs = pa.list_(pa.int64())
    kind = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", longs), ("sketch", longs), ("parities", longs)])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for column in texts:
            rows = []
            for t in column:
                hashes = shingle_set(t.as_py(), words, seed)
                minima = _minima(hashes)
                keys = [signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(minima[: BANDS * ROWS].reshape(BANDS, ROWS))]
                rows.append({"node": signed(xxhash.xxh64_intdigest(hashes.tobytes())), "n": len(hashes), "fp": signed(_majority(hashes)), "keys": keys, "sketch": _sketch(minima), "parities": _parities(hashes)})
            yield pa.array(rows, kind)

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "node bigint, n bigint, fp bigint, keys array<bigint>, sketch array<bigint>, parities array<bigint>")(text)


def _likely(least: float):
    """A test of sizes, sketches and parities that pairs of a similarity of `least` pass: sets of sizes further apart can't be alike, of
    the sketches' places as many differ as are to be expected and 4.3 standard deviations more, and no more parities than
    the hashes in one set only that this similarity allows. Sizes and parities lose no pair; parities tell small sets apart almost exactly."""
    p = 0.75 * (1 - least)
    most, half = int(MINIMA * p + 4.3 * (MINIMA * p * (1 - p)) ** 0.5), MINIMA // 64

    def likely(a: str, b: str) -> Column:
        other = [F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i]) for i in range(2 * half)]
        differing = sum((F.bit_count(other[i].bitwiseOR(other[half + i])) for i in range(half)), F.lit(0))
        n = [F.col(f"{x}_n") for x in (a, b)]
        odd = sum((F.bit_count(F.col(f"{a}_parities")[i].bitwiseXOR(F.col(f"{b}_parities")[i])) for i in range(PLACES // 64)), F.lit(0))
        return (F.least(*n) >= least * F.greatest(*n)) & (differing <= most) & (odd <= (1 - least) / (1 + least) * (n[0] + n[1]) + 1e-6)

    return likely


def _alike(pairs: DataFrame, texts: DataFrame, least: float, words: int, seed: int) -> DataFrame:
    """(a, b): those pairs of nodes whose texts have a shingle similarity of `least` or more, counted exactly; `texts` has a text for each node."""

    def batches(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sets, held = {}, 0

        def known(text: str) -> np.ndarray:
            """Its shingle set, remembered for a while: texts of a large group come again and again."""
            nonlocal held
            if text not in sets:
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                sets[text] = shingle_set(text, words, seed)
                held += sets[text].nbytes + 2 * len(text)
            return sets[text]

        for both in columns:
            yield pa.array([similarity(known(a.as_py()), known(b.as_py())) >= least for a, b in zip(*both, strict=True)], pa.bool_())

    batches.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")), x)
    return stored(pairs.where(F.arrow_udf(batches, "boolean")("a_text", "b_text")).select("a", "b"), release=True)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, seed: int = 42, least: float = 0.8, distance: int = 3) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of shingles is at least `least`. Candidates are texts whose SimHashes, over distinct shingles,
    `links` finds within `distance` bits. A similarity of 0.8 leaves some 10 of 64 bits different, which no index of signatures
    reaches, so MinHash proposes the rest: texts that share one of BANDS bands of ROWS minima, as 99.995 % of pairs of a
    similarity of 0.8 do, and whose sketches allow it, as about 99.998 % of those do. Rows with a null id stay and take no part; so do null, empty and blank
    texts. Of rows with one id all stay or none.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike("[^ \t-\r]"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    described = stored(rows.select("id", "mark", _described(F.col("text"), words, seed).alias("d")).select("id", "mark", "d.*"))
    nodes = stored(described.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch", "parities")]))
    members = described.select("id", "node")
    # of the nodes of one fingerprint, all are compared with the smallest, and so are the smallest of linked fingerprints
    tops = nodes.groupBy("fp").agg(F.min("node").alias("top"))
    near = links(nodes, distance)
    near = near.join(tops.select(F.col("fp").alias("a"), F.col("top").alias("x")), "a").join(tops.select(F.col("fp").alias("b"), F.col("top").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = near.union(nodes.join(tops, "fp").where("node != top").select(F.col("node").alias("a"), F.col("top").alias("b")))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first.*"), "node")
        # the texts are sized by packed files, so a sort and merge keeps them from the driver
        return _alike(pairs, ends.join(rows.hint("merge"), ["id", "mark"]).select("node", "text").dropDuplicates(["node"]), least, words, seed)

    groups = linked_groups(nodes.select("node", "n", "sketch", "parities", "keys"), ["n", "sketch", "parities"], _likely(least), verified, near)
    named = members.join(groups, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    named = stored(named.join(named.groupBy("component").agg(F.min("id").alias("smallest")), "component").select(F.col("id").alias(id_column), (F.col("id") == F.col("smallest")).alias("kept")), release=True)
    drop(described, nodes, groups)
    gone = named.where("not kept").select(id_column).distinct().join(named.where("kept").select(id_column), id_column, "left_anti")
    return docs.join(gone, id_column, "left_anti").select(docs.columns)
