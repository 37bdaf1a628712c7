"""Language identification: interpolated Kneser-Ney models of letters, one for each language.

Letters become symbols of BITS bits; anything else is a boundary. An n-gram is a number, its last letter lowest;
the context of a letter doesn't reach over the start of its word, and the end of a word is predicted too.
Counts cover all documents to learn from: each batch counts its n-grams, and Spark adds the counts up. The models are
sorted arrays of n-grams with a column of log-probabilities for each language. Their size is that of the n-grams within
words of the languages, some hundred thousand for alphabets.

A text's language is that of the lowest cross-entropy per letter. Scores and rejection are calibrated on all documents to learn from, each
measured by models that were not counted from it: the documents are dealt to two halves, and either is measured by models of the other. The score is a language's share
after entropies are scaled by a fitted factor, and a text whose entropy is higher than that of all but a few texts of its language, given its length, can be rejected as `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.blocks import blocks
from graphwright.sources.scratch import drop, stored

#: Characters of text to take n-grams of at a time.
BLOCK = 1 << 20
ORDER = 4
#: Bits of a symbol; 0 is the boundary.
BITS = 16
DISCOUNT = 0.75
#: Factors of entropies to choose from.
SCALES = [2.0**k for k in range(-2, 7)]
#: Values that may be collected to find one of a given rank, and bins to narrow more of them down with.
FEW, BINS = 10_000, 4_096
#: The share of a language's own texts that calibrated rejection is to accept, and how many texts a language needs for a limit of its own.
ACCEPT, ENOUGH = 0.98, 200
#: Letters beyond which the entropies of a language's texts come no closer together.
SPREAD = 400
UNDETERMINED = "und"
#: From here on come scripts of syllables and ideographs.
MANY = 0x2E80


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of letters' code points: their own number below MANY; beyond, 1,024 for each block of 4,096 letters, and for the last and all later blocks."""
    folded = 0xC000 + (np.minimum(codes >> 12, 15) - 2) * 1024 + codes % 1024
    return np.where(codes < MANY, codes, folded).astype(np.uint64)


_TABLES: list[np.ndarray] = []


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The text (its index) and the ORDER-gram of each letter and word end."""
    if not _TABLES:
        plane = np.arange(1 << 16)
        _TABLES.append(np.where([chr(c).isalpha() for c in plane], _symbols(plane), np.uint64(0)).astype(np.uint16))
    # two boundaries between texts, so that none is predicted from another
    joined = "\n\n".join((t or "").lower() for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    symbols = _TABLES[0][np.minimum(codes, (1 << 16) - 1)]
    for i in np.flatnonzero(codes >= 1 << 16):
        symbols[i] = _symbols(codes[i : i + 1].astype(np.int64))[0] if joined[i].isalpha() else 0
    symbols = symbols.astype(np.uint64)
    key, inside = symbols.copy(), np.ones(len(symbols), bool)
    for back in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back]
        inside &= before > 0
        key |= np.where(inside, before, np.uint64(0)) << np.uint64(BITS * back)
    at = np.flatnonzero(key)
    ends = np.cumsum([len((t or "").lower()) + 2 for t in texts])
    return np.searchsorted(ends, at, "right"), key[at]


def _last(grams: np.ndarray, order: int) -> np.ndarray:
    """The last `order` letters of n-grams."""
    return grams & np.uint64((1 << BITS * order) - 1)


def _context(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(BITS)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, values, len(distinct))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted numbers in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Models:
    """For each order from 1: sorted n-grams and their probabilities; sorted contexts and the weights of the order below.

    scale fits scores; for each language, usual is the entropy of its texts and limits what (entropy - usual) * sqrt(letters), of SPREAD letters at most, may be.
    """

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    chances: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    rests: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    usual: np.ndarray | None = None
    limits: np.ndarray | None = None

    def chance(self, order: int, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram, a column for each language."""
        if order == 0:
            return np.full((len(grams), len(self.languages)), 2.0**-BITS)
        out = np.empty((len(grams), len(self.languages)))
        at, known = _find(self.keys[order - 1], grams)
        out[known] = self.chances[order - 1][at[known]]
        rest = grams[~known]
        if len(rest):
            at, seen = _find(self.contexts[order - 1], _context(rest))
            weight = np.ones((len(rest), len(self.languages)))
            weight[seen] = self.rests[order - 1][at[seen]]
            out[~known] = weight * self.chance(order - 1, _last(rest, order - 1))
        return out

    def entropies(self, texts: list[str | None], logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text under each language, and the number of letters and word ends."""
        logs = self.logs() if logs is None else logs
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for lo, hi in blocks(texts, BLOCK):
            owner, gram = grams(texts[lo:hi])
            at, known = _find(self.keys[-1], gram)
            parts = logs[at]
            if not known.all():
                parts[~known] = np.log(self.chance(ORDER, gram[~known]))
            n[lo:hi] = np.bincount(owner, minlength=hi - lo)
            for i in range(len(self.languages)):
                total[lo:hi, i] = np.bincount(owner, parts[:, i], hi - lo)
        return -total / np.maximum(n, 1)[:, None], n

    def logs(self) -> np.ndarray:
        """Log-probabilities of the n-grams of the highest order."""
        return np.log(self.chances[-1]).astype(np.float32)

    def shares(self, entropies: np.ndarray) -> np.ndarray:
        """How likely each language is, from entropies."""
        raised = np.exp(-self.scale * (entropies - entropies.min(axis=1, keepdims=True)))
        return raised / raised.sum(axis=1, keepdims=True)

    def unlike(self, entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a text is unlike those of its best language, as far as that is calibrated."""
        if self.limits is None:
            return np.zeros(len(entropies), bool)
        best = entropies.argmin(axis=1)
        return np.sqrt(np.minimum(n, SPREAD)) * (entropies.min(axis=1) - self.usual[best]) > self.limits[best]

    def losses(self, entropies: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """What each text of a known language (its place) loses by each of SCALES."""
        low, own = entropies.min(axis=1, keepdims=True), entropies[np.arange(len(truth)), truth]
        most = -np.log(1e-12)
        return np.stack([np.minimum(np.log(np.exp(-k * (entropies - low)).sum(axis=1)) + k * (own - low[:, 0]), most) for k in SCALES], axis=1)


def ranked(values: DataFrame, place: int) -> float:
    """The place-th smallest (from 1) of a column `v`, exactly: bins narrow it down until few values are left."""
    while True:
        n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if low == high:
            return low
        if n <= FEW:
            return sorted(r.v for r in values.select("v").collect())[place - 1]
        # the same product for the same value, so equal values share a bin and bins are in order
        binned = values.withColumn("bin", F.floor((F.col("v") - low) * (BINS / (high - low))))
        for bin, inside in sorted(tuple(r) for r in binned.groupBy("bin").count().collect()):
            if place <= inside:
                break
            place -= inside
        values = binned.where(F.col("bin") == bin).select("v")


def calibrate(models: Models, measured: DataFrame) -> None:
    """Fit scale and limits to texts of known languages, measured by models that were not counted from them: (lang, its place; n letters; own, the entropy
    under its language; losses)."""
    found = measured.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.col("own") * F.col("n")).alias("own"), *[F.sum(F.col("losses")[k]).alias(f"loss{k}") for k in range(len(SCALES))])
    totals = {r.lang: r for r in found.collect()}
    if not totals:
        return
    models.scale = min(zip([sum(r[f"loss{k}"] for r in totals.values()) for k in range(len(SCALES))], SCALES, strict=True))[1]

    def far(some: DataFrame, texts: int, usual: float) -> float:
        """What so large a share of new texts stays within, whatever the distribution; no limit if there are too few texts to say."""
        place = int(np.ceil((texts + 1) * ACCEPT))
        return ranked(some.select((F.sqrt(F.least("n", F.lit(SPREAD))) * (F.col("own") - usual)).alias("v")), place) if place <= texts else np.inf

    usual, texts = (sum(r.own for r in totals.values()) / sum(r.n for r in totals.values())), sum(r.texts for r in totals.values())
    models.usual = np.full(len(models.languages), usual)
    models.limits = np.full(len(models.languages), far(measured, texts, usual))
    for i, r in totals.items():
        if r.texts >= ENOUGH:
            models.usual[i] = r.own / r.n
            models.limits[i] = far(measured.where(F.col("lang") == i), r.texts, r.own / r.n)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's ORDER-grams (distinct) and their counts."""
    models = Models(sorted(counts))
    levels: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, (keys, n) in counts.items():
        order = np.argsort(keys)
        levels[lang] = [(keys[order], n[order].astype(float))]
        for lower in range(ORDER - 1, 0, -1):  # below the top, the number of different letters before an n-gram counts
            keys = levels[lang][0][0]
            levels[lang].insert(0, _sums(_last(keys, lower), np.ones(len(keys))))
    for k in range(ORDER):
        every = np.unique(np.concatenate([levels[lang][k][0] for lang in models.languages]))
        contexts = np.unique(_context(every))
        chance, rest = np.zeros((len(every), len(models.languages))), np.ones((len(contexts), len(models.languages)))
        models.keys.append(every)
        below = models.chance(k, _last(every, k))
        for i, lang in enumerate(models.languages):
            keys, n = levels[lang][k]
            own, total = _sums(_context(keys), n)
            _, kinds = _sums(_context(keys), np.ones(len(keys)))
            rest[np.searchsorted(contexts, own), i] = DISCOUNT * kinds / total
            chance[np.searchsorted(every, keys), i] = np.maximum(n - DISCOUNT, 0) / total[np.searchsorted(own, _context(keys))]
        models.contexts.append(contexts)
        models.rests.append(rest)
        models.chances.append(chance + rest[np.searchsorted(contexts, _context(every))] * below)
    return models


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Models | None:
    """Models of the languages of `docs`, counted over all rows with a text and a language; None if there are none.

    One row for each language and n-gram that occurs is collected. Rows are dealt to two halves by their texts, so that copies stay together; models of either half measure
    all rows of the other, which fits scores and limits; the models that are returned count both. Without all languages in both halves nothing is calibrated.
    """
    known = docs.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text is not null and lang is not null")
    rows = known.withColumn("apart", F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(2)) == 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").dictionary_encode(), batch.column("text").to_pylist()
            names, apart = langs.dictionary.to_pylist(), batch.column("apart").to_numpy(zero_copy_only=False)
            which = langs.indices.to_numpy() * 2 + apart
            for lo, hi in blocks(texts, BLOCK):
                owner, gram = grams(texts[lo:hi])
                own = which[lo:hi][owner]
                for k in np.unique(own).tolist():
                    keys, n = np.unique(gram[own == k], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([names[k // 2]] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": n, "kept": n * (1 - k % 2)})

    found = rows.select("text", "lang", "apart").mapInArrow(counted, "lang string, gram long, n long, kept long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).toPandas()
    if found.empty:
        return None

    def built(n: pd.Series) -> Models:
        some = found[n > 0].assign(n=n[n > 0])
        return build({lang: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for lang, g in some.groupby("lang")})

    models, halves = built(found["n"]), [built(n) for n in (found["kept"], found["n"] - found["kept"]) if n.any()]
    del found
    if len(halves) == 2 and all(half.languages == models.languages for half in halves):

        def measured_by(half: Models):
            def batches(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                logs = half.logs()
                for batch in some:
                    entropies, n = half.entropies(batch.column("text").to_pylist(), logs)
                    truth = np.array([half.languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": truth, "n": n, "own": entropies[np.arange(len(truth)), truth], "losses": pa.array(half.losses(entropies, truth).tolist(), pa.list_(pa.float64()))})

            return batches

        first, second = (rows.where(which).select("text", "lang").mapInArrow(measured_by(half), "lang long, n long, own double, losses array<double>").where("n > 0") for which, half in zip(("apart", "not apart"), halves, strict=True))
        measured = stored(first.union(second))
        calibrate(models, measured)
        drop(measured)
    return models


def identify(text: Column, models: Models | None, reject: bool = True) -> Column:
    """struct<lang string, score double> for a text column.

    A null text, and one without letters, is `und` with score 0; so is every text if there are no models. Of languages that fit equally well the
    alphabetically first counts. With `reject`, a text unlike those of its best language is `und` too, and keeps its score. Repeated texts get the same answer.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logs = models.logs() if models else None
        for column in texts:
            if models and len(column):
                entropies, n = models.entropies(column.to_pylist(), logs)
                best, shares, away = entropies.argmin(axis=1), models.shares(entropies).max(axis=1), models.unlike(entropies, n) if reject else np.zeros(len(n), bool)
                score = np.where(n > 0, shares, 0.0)
                lang = [models.languages[b] if k and not u else UNDETERMINED for b, k, u in zip(best, n, away, strict=True)]
            else:
                lang, score = [UNDETERMINED] * len(column), np.zeros(len(column))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], fields=list(kind))

    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "lang string, score double")(text)
