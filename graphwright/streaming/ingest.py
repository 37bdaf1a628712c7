"""Streaming extensions: documents to triples as they come, and windows over results. The batch library needs neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.triples import SCHEMA


def document_triples(docs: DataFrame, graph_id: str = "stream") -> DataFrame:
    """Knowledge triples of a document stream (doc_id, text, source): a projection, so it keeps no state."""
    node = F.concat(F.lit("oc:kn_"), F.col("doc_id").cast("string"))
    facts = F.array(
        F.struct(F.lit("rdf:type").alias("p"), F.lit("oc:Standard").alias("o"), F.lit("iri").alias("o_kind")),
        F.struct(F.lit("oc:directiveContent").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind")),
        F.struct(F.lit("oc:appliesToContext").alias("p"), F.col("source").alias("o"), F.lit("literal").alias("o_kind")),
    )
    rows = docs.select(node.alias("s"), F.explode(facts).alias("f"))
    none = F.lit(None).cast("string")
    return rows.where("f.o is not null").select(F.lit(graph_id).alias("graph_id"), "s", F.lit("iri").alias("s_kind"), "f.p", "f.o", "f.o_kind", none.alias("o_dt"), none.alias("o_lang"))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Start appending the triples of Parquet files that come to `source` to the table at `target`, by predicate; exactly once by the checkpoint."""
    triples = document_triples(spark.readStream.schema(schema).parquet(source))
    return triples.writeStream.format("parquet").partitionBy("p").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latency_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means of results in tumbling windows by benchmark; rows later than the watermark don't count."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("bench")).agg(F.count("*").alias("n"), F.avg("value").alias("avg_latency"))
    return rows.select(F.col("window.start").alias("start"), "bench", "n", "avg_latency")


__all__ = ["SCHEMA", "document_triples", "ingest", "latency_windows"]
