"""Intermediate tables in the folder that driver and executors share, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders not yet dropped, with what can delete them.
_open: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own: for a local session a temporary one, else one in the warehouse, which a cluster shares."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), "graphwright-tables")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphwright-tables"


def _delete(path: str) -> None:
    spark = _open.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_open):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may have ended before
            _open.pop(path, None)


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used, deleted with whatever is written there when Python ends."""
    path = f"{shared_folder(spark)}/graphwright-{uuid.uuid4().hex}"
    _open[path] = spark
    return path


def stored(df: DataFrame, release: bool = False, rows: int = 0) -> DataFrame:
    """The same rows, read from a table written now, in files of at most `rows` if given. With `release`, large shuffles behind it that nothing else needs leave the disks at once, not
    when the driver's memory is next cleared."""
    spark, schema = df.sparkSession, df.schema
    path = fresh(spark)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def together(*tables: DataFrame) -> DataFrame:
    """The rows of stored tables of one schema, as one scan: a union of many rounds would be a plan that grows with them."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.stored_at for t in tables])


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for table in tables:
        _delete(table.stored_at)


#: Rows of a table that one task takes where each becomes many.
ROWS = 50_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt by a key over tasks by their number. A file of numbers and short words packs so small, or has row groups so long, that one task would read millions of its rows and hold
    all that is made of them."""
    n = df.count()
    return df.repartition(-(-n // ROWS), key) if n > ROWS else df


def sized_at_run_time(spark: SparkSession) -> SparkSession:
    """A session of the same settings in which joins are broadcast by the sizes that adaptive execution measures, up to the same limit. Sizes planned from files mislead here:
    derived rows pack to a hundredth, and what is exploded from a row isn't counted, so tables of millions of rows would go by the driver."""
    out = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            out.conf.set(name, value)
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            out.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        out.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return out
