"""The corpus pipeline: stages applied one after the other to the documents table.

Each stage works on all rows that the one before it kept, and reads them from the table that stage
was written to. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import bpe, decontaminate, quality, queries, simhash, suffix
from graphwright.sources.scratch import stored

#: Documents below this score are rejected.
QUALITY = 0.5
#: Bytes of a string that may not repeat.
REPEAT = 200


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, learned outside its held-out fold, scores below QUALITY."""
    trees = queries.quality_model(queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), trees) >= QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of texts whose five-word shingles are 0.8 alike or more."""
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts whole characters of strings of REPEAT bytes that also start elsewhere out of texts; documents stay, n_chars follows."""
    out = next(name for i in range(len(docs.columns) + 1) if (name := f"repeats_{i}") not in docs.columns)
    cut = suffix.without_repeats(docs, length=REPEAT, out=out, whole_characters=True)
    same = F.col(f"{out}.n_removed") == 0
    text = F.when(F.col("text").isNull() | same, F.col("text")).otherwise(F.decode(f"{out}.kept", "UTF-8"))
    changed = cut.withColumn("text", text).withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in whose text a benchmark item stands, within its error budget."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of each text, their number, and digests of identifiers and of the decoded text."""
    coded = docs.select("doc_id", "lang", "source", bpe.encode_decode(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("coded"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("coded.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each but the last is written to a table and read again."""
    docs = queries.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
