"""Streams: state across batches and a restart, late and repeated rows, equal to the batch result; ingest; windows."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphwright.operators import bench
from graphwright.streaming import ingest, results

SCHEMA = "task_id string, attempt long, reward double, counted boolean, limited boolean"


@pytest.fixture(scope="module")
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, results.STORE)
    yield
    if before:
        spark.conf.set(key, before)
    else:
        spark.conf.unset(key)


def run(spark, tmp_path, make, batches, name, key="task_id"):
    """Each batch is one file and one run of the query, which starts anew from its checkpoint; the last update of a task holds."""
    last = {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = []
        stream = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, out=out: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for r in out:
            last[r[key]] = tuple(r)
    return last


FIRST = [("a", 1, 0.5, True, False), ("a", 2, 0.9, False, False), ("b", 3, None, True, True), ("b", 1, 0.2, True, True), (None, 1, 0.1, True, False), ("c", None, 0.7, True, False)]
SECOND = [("a", 4, 0.8, True, False), ("a", 3, 0.8, True, False), ("b", 2, 0.2, True, True), ("b", 4, 0.1, True, True), ("a", 1, 0.5, True, False)]
THIRD = [("b", 5, 0.0, None, True), ("d", 9, None, None, None), ("a", 0, 0.8, True, False)]


def test_best_attempts_equal_the_batch_result(spark, tmp_path, store):
    got = run(spark, tmp_path, results.best_attempts, [FIRST, SECOND, THIRD], "best")
    whole = spark.createDataFrame(FIRST + SECOND + THIRD, SCHEMA)
    want = {r.task_id: tuple(r) for r in bench.attempts(whole).select("task_id", "best_reward", "best_attempt", "next_attempt").collect()}
    assert {k: v for k, v in got.items() if k != "c"} == {k: v for k, v in want.items() if k != "c"}
    assert got["c"] == ("c", 0.7, None, None)


def test_error_runs_end_at_five(spark, tmp_path, store):
    # the fourth of b comes late, and so does the second of e, which broke the run
    late = [("e", n, None, None, True) for n in (1, 3, 4)]
    got = run(spark, tmp_path, results.error_runs, [FIRST + late, SECOND, [*THIRD, ("e", 5, None, None, True), ("e", 2, None, None, False)], [("b", 6, 1.0, True, False), ("e", 6, None, None, True)]], "runs")
    assert got["b"] == ("b", 5, 5, True)
    assert got["e"] == ("e", 6, 4, False)
    assert got["a"][2:] == (0, False) and got["d"] == ("d", 9, 0, False)


class Value:
    """State of a task, held here."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers, self.values = [], {}

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_idle_tasks_are_forgotten():
    """Each row of a task sets its one timer anew; when that fires, the state goes."""
    handle, task = Handle(), results.BestAttempt(idle=50)
    task.init(handle)
    rows = pd.DataFrame({"attempt": [1, 2], "reward": [0.9, 0.3], "counted": [True, True]})
    for _ in range(2):
        assert next(task.handleInputRows(("a",), iter([rows]), handle)).iloc[0].tolist() == ["a", 0.9, 1, 3] and handle.timers == [1050]
    assert list(task.handleExpiredTimer(("a",), handle, None)) == [] and not handle.values["best"].exists()
    assert next(task.handleInputRows(("a",), iter([rows[1:]]), handle)).iloc[0].tolist() == ["a", 0.3, 2, 3]


def test_documents_are_ingested_once(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    for rows in ([(1, "one", "s"), (2, None, None)], [(3, "three", "s")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        ingest.ingest(spark, str(tmp_path / "docs"), schema, str(tmp_path / "graph"), str(tmp_path / "check")).awaitTermination(120)
    got = {(r.s, r.p, r.o) for r in spark.read.parquet(str(tmp_path / "graph")).collect()}
    assert len(got) == spark.read.parquet(str(tmp_path / "graph")).count() == 7 and ("oc:kn_3", "oc:directiveContent", "three") in got and ("oc:kn_2", "rdf:type", "oc:Standard") in got


def test_windows_of_latency(spark):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(at(1, 5), "x", 1.0), (at(1, 55), "x", 3.0), (at(2, 0), "x", 5.0), (at(1, 0), "y", None)], "ts timestamp, event_type string, value double")
    assert sorted(map(tuple, ingest.latency_windows(rows).collect()), key=str) == sorted([(at(1, 0), "x", 2, 2.0), (at(2, 0), "x", 1, 5.0), (at(1, 0), "y", 1, None)], key=str)
    assert rows.where(F.col("value") > 9).count() == 0
