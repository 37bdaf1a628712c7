"""Repeated rows, clashing names, ties and ids of another type, for operators whose own tests leave them out."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphwright.llm import bpe, decontaminate, editprint


def test_decontamination_of_clashing_names_and_long_texts(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, item, "x", 1, 2), (1, item, "x", 1, 2), (2, "pad " * 50_000 + item + " tail", "y", 3, 4), (3, "", "z", 0, 0), (None, item, None, None, None)], "doc_id long, text string, item string, distance int, id int")
    items = spark.createDataFrame([(7, item, "n"), (8, None, "n"), (9, "", "n")], "item_id long, text string, doc_id string")
    found = sorted((r.id is None, r.id or 0, r.item, r.distance) for r in decontaminate.matches(docs, items).collect())
    assert found == [(False, 1, 7, 0), (False, 1, 7, 0), (False, 2, 7, 0), (True, 0, 7, 0)]
    assert decontaminate.matches(docs.limit(0), items).collect() == decontaminate.matches(docs, items.limit(0)).collect() == []


def test_coding_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "aaaa aaaa abab", "i", 1)] * 3 + [(2, "aaaa aaaa abab " * 2_000, "i", 1)], "doc_id int, text string, ids string, decoded int")
    rows = df.select("doc_id", "ids", bpe.encode_decode(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("coded"), bpe.token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n")).collect()
    one = [r for r in rows if r.doc_id == 1]
    assert len(rows) == 4 and len({(bytes(r.coded.ids), r.coded.decoded, r.n) for r in one}) == 1 and one[0].ids == "i"
    long = next(r for r in rows if r.doc_id == 2)
    assert bytes(long.coded.ids) == bytes(one[0].coded.ids) * 2_000 and long.n >= one[0].n


def test_next_texts_need_numbers(spark):
    with pytest.raises(TypeError):
        editprint.with_next(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    rows = editprint.with_next(spark.createDataFrame([(1, "b", "n"), (1, "a", "n"), (None, "z", "n"), (2, None, "n")], "doc_id long, text string, next_text string")).collect()
    assert sorted((str(r.id), r.text, r.next_text) for r in rows) == [("1", "a", "b"), ("1", "b", ""), ("2", "", "z"), ("None", "z", "a")]
