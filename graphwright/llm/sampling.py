"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    """Whether an id's CRC-32, as text, leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled documents, those whose ids hash lowest; null texts are empty.

    Rows of labels with a null id or label, or that `learn` leaves out, are dropped; of several labels
    of an id the greatest counts, and of several texts the least. The ids are at most `most` rows, so they are broadcast.
    """
    chosen = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
