"""Source divergence audit: how far the terms of each source of a language lie from those of the other sources, in exact integers.

A group (language, source) and a language as a whole give each kept term a share p of 10^9, smoothed by two occurrences. Two shares p and q
are f = (p - q)^2 div (p + q) apart.

For a pair of sources only the number of terms with each combination of counts matters: f is evaluated once for a combination and
multiplied by that number. Combinations of terms that both sources have are tallied in numpy, for a slice of the terms at a time, and only tallies leave a
task. Combinations with a zero are implied: they follow from each source's own histogram of counts, less what the tallies have.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.sources.scratch import drop, stored

#: Bytes of UTF-8 that belong to terms, A-Z lower-cased; all others are spaces. Bytes from 0x80 on are those of other letters and signs.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
#: Distinct (group, term) that a task counts before it passes them on.
REMEMBERED = 300_000
#: Pairs of counts that a task tallies at a time.
TALLIED = 2_000_000
SCALE, SMOOTHING = 1_000_000_000, 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, added up over some rows; and a row with an empty term for each group."""
    occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[tuple[str, str], Counter] = defaultdict(Counter)
    seen: set[tuple[str, str]] = set()

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            docs = documents[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            group = (lang, source)
            if group not in seen:
                seen.add(group)
                occurrences[group][b""] = 0
            words = (text.as_py() or b"").translate(LETTERS).split(b" ")
            occurrences[group].update(filter(None, words))
            words = set(words)
            words.discard(b"")
            documents[group].update(words)
            if len(seen) > REMEMBERED:
                seen.clear()
        if sum(map(len, occurrences.values())) > REMEMBERED:
            yield from out()
    yield from out()


def kept_counts(docs: DataFrame, least: int, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the terms in at least `least` documents of a language, and those of the whole language.

    One row of a term in a language is its `first`. Each group has one row more, with an empty term and a count of 0.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_column), ("source", source_column))], F.col(text_column).cast("binary").alias("text"))
    counted = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    groups = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = groups.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return found.where((F.col("lang_docs") >= least) | (F.col("term") == F.lit(b""))).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first")


def _pairs(term: np.ndarray, source: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(source, other, count, other's count) of each pair of rows of a term, some at a time; rows of a term stand together."""
    held, size = [], 0
    for gap in range(1, len(term)):
        at = np.flatnonzero(term[:-gap] == term[gap:])
        if not len(at):
            break
        for start in range(0, len(at), TALLIED):
            i = at[start : start + TALLIED]
            held.append((source[i], source[i + gap], count[i], count[i + gap]))
            size += len(i)
            if size >= TALLIED:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, other, a, b, terms): the number of terms with counts a in a source and b in another, source < other. Rows come term by term."""
    waiting: pa.Table | None = None

    def tallies(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole terms, that is, of rows sorted by language, term and source."""
        langs, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
        sources = rows.column("source").combine_chunks().dictionary_encode()
        at = sources.indices.to_numpy()
        lang = langs.indices.to_numpy()
        term = lang.astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
        counts = rows.column("n").to_numpy()
        for k, name in enumerate(langs.dictionary.to_pylist()):
            mine = lang == k
            for s, t, a, b in _pairs(term[mine], at[mine], counts[mine]):
                found = pd.DataFrame({"pair": s.astype(np.int64) * len(sources.dictionary) + t, "a": a, "b": b}).groupby(["pair", "a", "b"], sort=False).size().reset_index(name="terms")
                s, t = np.divmod(found["pair"].to_numpy(), len(sources.dictionary))
                names = [pa.array([name] * len(found), pa.string()), sources.dictionary.take(pa.array(s)), sources.dictionary.take(pa.array(t))]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(found[c].to_numpy(), pa.int64()) for c in ("a", "b", "terms")]], ["lang", "source", "other", "a", "b", "terms"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        if not rows.num_rows:
            continue
        # the last term may go on in the next batch
        lang, term = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
        last = np.flatnonzero(~(np.asarray(pc.equal(term, term[-1])) & np.asarray(pc.equal(lang, lang[-1]))))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield from tallies(rows.slice(0, whole))
        waiting = rows.slice(whole)
    if waiting is not None and waiting.num_rows:
        yield from tallies(waiting)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, in units of 10^-9. Decimals hold the product of any count."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    whole = F.greatest(total + SMOOTHING * terms, F.lit(1)).cast("decimal(20,0)")
    return 1 + F.call_function("div", product, whole)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, best: int = 10, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distances to the other sources of the language (`pair`), and the `best` terms that it has more of than the language (`term`).

    Nulls count as empty strings, and so do groups of them. Texts are read whole; repeated rows count each time. A language
    without kept terms has distances of 0; one with a single source has no pairs; an empty table gives no rows. Equal values rank by
    item, in the order of its bytes. Other columns of `docs` are ignored, whatever their names.
    """
    kept = stored(kept_counts(docs, least, text_column, lang_column, source_column), release=True)
    words = kept.where("term <> ''")
    of_langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("terms"))
    of_groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("own")).join(of_langs, "lang")
    groups = stored(of_groups)

    # terms that a group has more of than its language
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shares = words.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = shares.select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = more.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= best).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # combinations of counts of each pair of sources, source < other
    one = groups.select("lang", "source", "total", "terms")
    other = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    pairs = one.join(other, "lang").where("source < other")
    both = words.select("lang", "source", "term", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = stored(both.mapInArrow(_tallied, "lang string, source string, other string, a long, b long, terms long").groupBy("lang", "source", "other", "a", "b").agg(F.sum("terms").alias("n")))
    zero = F.lit(0).cast("long")
    alone = words.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("n"))
    names = pairs.select("lang", "source", "other")
    key = ["lang", "source", "other"]

    def cells(rows: DataFrame, *signed: tuple[Column, Column, int]) -> DataFrame:
        return rows.select(*key, F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b"), (sign * F.col("n")).alias("n")) for a, b, sign in signed])))

    count = F.col("count")
    combinations = (
        cells(both, (F.col("a"), F.col("b"), 1), (F.col("a"), zero, -1), (zero, F.col("b"), -1), (zero, zero, 1))
        .unionByName(cells(names.join(alone, ["lang", "source"]), (count, zero, 1), (zero, zero, -1)))
        .unionByName(cells(names.join(alone.withColumnRenamed("source", "other"), ["lang", "other"]), (zero, count, 1), (zero, zero, -1)))
        .unionByName(cells(pairs.withColumnRenamed("terms", "n"), (zero, zero, 1)))
    )
    combinations = combinations.groupBy(*key, "a", "b").agg(F.sum("n").alias("n"))
    p, q = _share(F.col("a"), F.col("total"), F.col("terms")), _share(F.col("b"), F.col("other_total"), F.col("terms"))
    valued = combinations.join(pairs, key).select(*key, "n", p.alias("p"), q.alias("q"))
    sums = valued.groupBy(*key).agg(F.sum(F.col("n") * _apart(F.col("p"), F.col("q"))).alias("value"))
    # f is the same either way
    ways = F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    mirrored = sums.select("lang", "value", F.inline(ways))
    out = stored(top.unionByName(mirrored.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))))
    drop(kept, groups, both)
    return out


def oracle(least: int = 10, best: int = 10) -> str:
    """The contract in SQL, term by term and pair by pair."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    return f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT lang, source, r, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
l AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, v, lang_total, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source, v, lang_total),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share.format(n="coalesce(n, 0)", total="total")} AS p, {share.format(n="lang_n", total="lang_total")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM a WHERE n > 0 AND p > q),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM t UNION ALL FROM pair))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {best}"""
