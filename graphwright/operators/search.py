"""Ranking: BM25 over postings, vectors by dot product, the adaptive cut-off and quality weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.stem import STOP_WORDS, stem
from graphwright.operators.catalog import WEIGHTS

K1, B = 1.2, 0.75


def tokens(text: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of ASCII letters and digits; with `stemmed`, without stop words and cut to their stems."""
    found = F.filter(F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return stems(F.filter(found, lambda w: ~w.isin(*STOP_WORDS))) if stemmed else found


def stems(words: Column) -> Column:
    """Each word's stem."""

    def batch(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [stem(w) for w in ws])

    batch.__annotations__ = {"words": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<string>")(words)


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _query_terms(query: str, stemmed: bool) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in query).lower().split()
    return sorted({stem(w) for w in words if w not in STOP_WORDS} if stemmed else set(words))


def bm25(docs: DataFrame, query: str, id_column: str = "doc_id", text_column: str = "text", stemmed: bool = False) -> DataFrame:
    """(id, score) of the documents with a word of the query.

    Only the query's words are counted, within each row, so nothing is exploded and the corpus isn't shuffled: one pass gives each row's
    length and its counts of the query's words, and one row of statistics (documents, mean length, documents with each word) is added up.
    An empty corpus takes a mean length of 10.
    """
    terms = _query_terms(query, stemmed)
    rows = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column), stemmed).alias("words"))
    rows = rows.select("id", F.size("words").alias("length"), *[_count("words", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(10.0)).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false")
    return hits.crossJoin(F.broadcast(totals)).select("id", score.alias("score"))


def postings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stemmed: bool = False) -> DataFrame:
    """(term, id, tf, length): the index of a corpus. Written by `store_index`, a search reads the rows of its own words only.

    A document without words has one row with a null term, so that it counts among the documents and in their mean length.
    """
    rows = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column), stemmed).alias("words")).select("id", F.size("words").alias("length"), F.explode_outer("words").alias("term"))
    return rows.groupBy("term", "id", "length").agg(F.count("term").alias("tf")).select("term", "id", "tf", "length")


def store_index(index: DataFrame, path: str) -> None:
    """Postings as Parquet clustered by term, with a table of the documents' number and mean length beside them."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
    lengths = index.groupBy("id").agg(F.max("length").alias("length"))
    lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(10.0)).alias("mean")).write.parquet(f"{path}/totals")


def bm25_indexed(spark, path: str, query: str, stemmed: bool = False) -> DataFrame:
    """(id, score) as `bm25` gives it, from a stored index: a filter on the term prunes its row groups, and documents with no word of the query aren't read."""
    hits = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(_query_terms(query, stemmed)))
    totals = spark.read.parquet(f"{path}/totals")
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    rows = hits.join(F.broadcast(seen), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def cutoff(scored: DataFrame, least: float, gap: float, partition: Sequence[str] = (), score: str = "score", tie: str = "id") -> DataFrame:
    """The rows of each partition up to an adaptive cut: none if the best is below `least`; up to the first fall of more than
    `gap` to a score below `least`; else all of at least `least`. For short lists, such as the best k of a search.
    """
    keys = list(partition) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    whole = Window.partitionBy(*keys)
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("before", F.lag(score).over(order))
    falls = F.min(F.when((F.col("before") - F.col(score) > gap) & (F.col(score) < least), F.col("rank"))).over(whole)
    keep = F.when(F.max(score).over(whole) < least, F.lit(0)).otherwise(F.coalesce(falls - 1, F.count_if(F.col(score) >= least).over(whole)))
    return ranked.withColumn("keep", keep).where("rank <= keep").drop("before", "keep")


def cut_score(scored: DataFrame, least: float, gap: float, score: str = "score") -> DataFrame:
    """One row, (cut): the score that `cutoff` keeps rows from, of any number of rows and without an order of all; null if it keeps none.

    A fall of more than `gap` is one between neighbouring buckets half as wide, from the least of one to the greatest of the next below, so only buckets are put in order.
    """
    buckets = scored.groupBy(F.floor(F.col(score) / (gap / 2)).alias("bucket")).agg(F.max(score).alias("high"), F.min(score).alias("low"))
    below = F.lead("high").over(Window.orderBy(F.desc("bucket")))
    falls = buckets.withColumn("next", below).select("high", F.when((F.col("low") - F.col("next") > gap) & (F.col("next") < least), F.col("low")).alias("end"))
    return falls.agg(F.when(F.max("high") >= least, F.coalesce(F.max("end"), F.lit(least))).alias("cut"))


def weight(tier: Column) -> Column:
    """The weight of a trust tier; 1 for one that isn't known."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[tier], F.lit(1.0))


def search_skills(skills_wide: DataFrame, query: str, top_k: int = 5, stemmed: bool = True) -> DataFrame:
    """The best skills for a query by their intents, aliases and nature: 2 top_k are fetched, weighted by tier, cut off and shortened."""
    docs = skills_wide.select(F.col("qualified_id").alias("id"), F.concat_ws(" ", F.array_join("intents", " "), F.array_join("aliases", " "), "nature").alias("text"))
    best = bm25(docs, query, "id", "text", stemmed).orderBy(F.desc("score"), "id").limit(2 * top_k)
    tiers = skills_wide.select(F.col("qualified_id").alias("id"), "trust_tier")
    weighted = best.join(tiers, "id").withColumn("score", F.col("score") * weight(F.col("trust_tier")))
    return cutoff(weighted, 0.1, 0.15).where(F.col("rank") <= top_k)


def rank_nodes(nodes: DataFrame, query: str, group: str = "uri") -> DataFrame:
    """Each skill's knowledge nodes (directive_content, applies_to_context, rationale) by BM25 within the skill.

    An empty query gives all with score 0. Else the lowest fifth of those that score goes, but 10 stay if there are so many.
    Statistics are those of the skill, by windows over its nodes.
    """
    terms = _query_terms(query, True)
    if not terms:
        return nodes.withColumn("score", F.lit(0.0))
    whole = Window.partitionBy(group)
    rows = nodes.withColumn("words", tokens(F.concat_ws(" ", "directive_content", "applies_to_context", "rationale"), True)).withColumn("length", F.size("words"))
    score: Column = F.lit(0.0)
    for i, term in enumerate(terms):
        rows = rows.withColumn(f"tf{i}", _count("words", term))
        df, n = F.count_if(F.col(f"tf{i}") > 0).over(whole), F.count("*").over(whole)
        tf = F.col(f"tf{i}")
        score = score + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.avg("length").over(whole), F.lit(1e-9))))
    scored = rows.withColumn("score", score).withColumn("all", F.count("*").over(whole)).where("score > 0")
    order = Window.partitionBy(group).orderBy(F.desc("score"), "node")
    n = F.count("*").over(whole)
    keep = F.greatest(F.least(F.lit(10), F.col("all")), n - F.floor(n * 0.2))
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("keep", keep).where("rank <= keep").select(*nodes.columns, "score")


def fit_budget(sections: DataFrame, budget: int, group: str = "uri", order: Sequence[str] = ("rank",), content: str = "content") -> DataFrame:
    """Each group's sections in order, as many as fit in so many bytes; one that doesn't fit is skipped and the next is tried. Equal ones in order are tried by their content; null and empty ones always fit.

    Once a section of some size is skipped, no later one of that size fits, and no more than budget / size of them can. So of each size only the first
    budget / size are tried: at most budget * (1 + ln budget) of a group, whatever the group has. What is folded, with the room left as its state, is their
    sizes alone, in the order of the group.
    """
    size = F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long")
    sized = sections.withColumn("_size", size)
    empty = sized.where("_size = 0").drop("_size")
    first = Window.partitionBy(group, "_size").orderBy(*order, content)
    tried = sized.where((F.col("_size") > 0) & (F.col("_size") <= budget)).withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= F.lit(budget) / F.col("_size"))
    # the first by order, then by content as the size and place within it don't tell
    key = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], F.xxhash64(content).alias("h"), F.col("_size").alias("size"), F.col("_i").alias("i"))
    rows = tried.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("_tried"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<size:bigint,i:int>>").alias("taken"))

    def take(state: Column, x: Column) -> Column:
        fits = x["size"] <= state["left"]
        one = F.array(F.struct(x["size"].alias("size"), x["i"].cast("int").alias("i")))
        return F.struct(F.when(fits, state["left"] - x["size"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["taken"], one)).otherwise(state["taken"]).alias("taken"))

    taken = rows.select(F.col(group).alias("_g"), F.inline(F.aggregate("_tried", start, take)["taken"])).toDF("_g", "_taken_size", "_taken_i")
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_size") == F.col("_taken_size")) & (F.col("_i") == F.col("_taken_i"))
    return tried.join(taken, same, "left_semi").select(sections.columns).unionByName(empty)


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: Sequence[float], top_k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, score) of the nearest vectors by cosine, of the query's length; one pass and a top-k."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size(vector_column) == len(query))
    scored = rows.select(F.col(id_column).alias("id"), dot(normalise(F.col(vector_column)), normalise(literal)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(top_k)


def semantic_search(intents: DataFrame, query: Sequence[float], skills_wide: DataFrame, top_k: int = 5) -> DataFrame:
    """Intents (intent, embedding, skills) by cosine times the best weight of their skills: all are cut off first, the best top_k of what is left stay. Skills unknown weigh 1, as do none."""
    weights = intents.select("intent", F.explode("skills").alias("id")).join(skills_wide.select("id", "trust_tier"), "id", "left").groupBy("intent").agg(F.max(weight(F.col("trust_tier"))).alias("w"))
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = intents.where(F.size("embedding") == len(query)).join(weights, "intent", "left")
    scored = scored.select(F.col("intent").alias("id"), "skills", (dot(normalise(F.col("embedding")), normalise(literal)) * F.coalesce("w", F.lit(1.0))).alias("score"))
    kept = scored.crossJoin(F.broadcast(cut_score(scored, 0.4, 0.15))).where("score >= cut")
    return kept.orderBy(F.desc("score"), "id").limit(top_k).select("id", "skills", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1; null if there is none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(F.element_at(kept, 1)["v"], lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def intent_index(t: DataFrame) -> DataFrame:
    """(intent, skills): the distinct skills of each intent, by identifier, else by local name, sorted."""
    from graphwright.functions.terms import local_name
    from graphwright.operators.triples import facts

    named = facts(t, "oc:resolvesIntent", "uri", "intent").join(facts(t, "dcterms:identifier", "uri", "id"), "uri", "left")
    return named.groupBy("intent").agg(F.array_sort(F.collect_set(F.coalesce("id", local_name(F.col("uri"))))).alias("skills"))


def embed(texts: DataFrame, model, text_column: str = "intent", dimension: int = 384) -> DataFrame:
    """Unit vectors from a model: any callable from a list of texts to rows of numbers, called once a batch."""

    def batches(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in rows:
            yield pd.Series([[float(x) for x in v][:dimension] for v in model(column.tolist())])

    batches.__annotations__ = {"rows": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn("embedding", normalise(F.pandas_udf(batches, "array<double>")(text_column)))
