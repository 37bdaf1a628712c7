"""The registered queries opN_<name>: each applies its operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import bpe, decontaminate, divergence, editprint, langid, lexical, licences, quality, reputation, sampling, simhash, suffix, toxicity
from graphwright.sources.scratch import stored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every whole text and names its group."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated strings of 200 bytes from every whole text."""
    removed = suffix.without_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=200)
    return removed.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names the licences whose sentences every whole text has."""
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licence.sentence_ids", ",").alias("sentence_ids"), F.array_join("licence.licences", ",").alias("licences"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that stand in whole texts with at most 8 edits for 100 characters."""
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=decontaminate.RATE)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "ends_at")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text for toxicity, by weights learned outside the held-out fold."""
    docs, labels, held = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), sampling.in_fold("doc_id", 4, 2)
    model = toxicity.learn(sampling.labelled_sample(docs, labels, "toxic", ~held, toxicity.SAMPLE))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Trees:
    """Trees learned outside the held-out fold."""
    return quality.learn(sampling.labelled_sample(docs, labels, "quality", ~sampling.in_fold("doc_id", 3, 1), quality.SAMPLE))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text for quality, by trees learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    trees = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", sampling.in_fold("doc_id", 3, 1).alias("held_out"), quality.score(F.col("text"), trees).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; the digests are those of the identifiers and of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = documents(spark, sf_dir).select("doc_id", bpe.encode_decode(F.col("text"), path).alias("coded"))
    return coded.select(
        "doc_id",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("coded.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names the language of every whole text, by models counted outside the held-out fold. By contract only texts without letters are rejected."""
    docs, held = documents(spark, sf_dir), sampling.in_fold("doc_id", 4, 2)
    found = docs.select("doc_id", held.alias("held_out"), langid.identify(F.col("text"), langid.learn(docs.where(~held)), reject=False).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every whole text; over_limit marks texts of more than 1024."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), bpe.token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def _compared(docs: DataFrame) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""
    both = editprint.with_next(docs)
    changed = F.sha2(F.encode(editprint.edited_text(F.col("text"), F.col("next_text")), "UTF-8"), 256)
    return both.select("id", F.length("text").cast("long").alias("n_chars"), changed.alias("edited_sha256"), editprint.compare(F.col("text"), F.col("next_text")).alias("c")).select("id", "n_chars", "edited_sha256", "c.*")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every whole text and its edited text, compares them and the next document's, and names the group of documents with alike fingerprints."""
    found = stored(_compared(documents(spark, sf_dir)), release=True)
    prints = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return editprint.near_groups(found, id_column="id").select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *prints, "near_edited", "near_next", "group_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language by their terms, and the terms that set each source apart."""
    return divergence.audit(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    found = lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page by rules and by its host's reputation: a page is bad whose document, numbered in its path, is marked low in quality or toxic."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    marks = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when((F.col("quality") == 1) | (F.col("toxic") == 0), F.lit(0))
    doc = F.regexp_extract(reputation.path(F.col("url")), "/([0-9]+)", 1).try_cast("long")
    judged = reputation.judge(pages, labels.select(F.col("doc_id").alias("doc"), marks.alias("bad")), doc=doc)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bound"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licences": op3_licences,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_url_filters": op13_url_filters,
}

ORACLE_SQL: dict[str, str] = {"op3_licences": licences.oracle(), "op11_source_divergence": divergence.oracle(), "op12_ranked_search": lexical.oracle(), "op13_url_filters": reputation.oracle()}
