"""Benchmark results as they come: the best attempt of each task, and runs of rate-limit errors, kept as state across batches and restarts.

State is keyed by task and lives in the state store, so it survives a restart from the checkpoint. Timers drop the state of tasks that nothing has come for in a while. Rows of a
task may come late or twice: attempts count by their numbers, not by when they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Errors in a row after which a task is given up.
MOST_ERRORS = 5
BEST = "task_id string, best_reward double, best_attempt long, next_attempt long"
RUNS = "task_id string, attempt long, errors int, stopped boolean"
#: The store that keyed state needs; set as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestAttempt(StatefulProcessor):
    """What `bench.attempts` gives, row by row: best counted reward, the least attempt that has it, and the number after the greatest."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "reward double, attempt long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reward, attempt, last = self.best.get() if self.best.exists() else (None, None, None)
        for batch in rows:
            for number, got, counted in zip(batch["attempt"], batch["reward"], batch["counted"], strict=True):
                if not pd.isna(number):
                    last = int(number) if last is None else max(last, int(number))
                if not counted or pd.isna(counted) or pd.isna(got):
                    continue
                n = None if pd.isna(number) else int(number)
                if reward is None or (got, -(n if n is not None else 1 << 62)) > (reward, -(attempt if attempt is not None else 1 << 62)):
                    reward, attempt = float(got), n
        self.best.update((reward, attempt, last))
        _remind(self.handle, timerValues, self.idle)
        yield pd.DataFrame({"task_id": [key[0]], "best_reward": [reward], "best_attempt": pd.array([attempt], "Int64"), "next_attempt": pd.array([None if last is None else last + 1], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


class ErrorRuns(StatefulProcessor):
    """Runs of rate-limit errors of a task by the numbers of its attempts; the task stops at the first run of MOST_ERRORS, for good.

    Attempts are kept from the last one on that isn't an error, and no more than MOST_ERRORS beyond it, so a late attempt that breaks a run is seen while the run is open.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stopped = handle.getValueState("stopped", "attempt long")
        self.seen = handle.getMapState("seen", "attempt long", "limited boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts = {k[0]: v[0] for k, v in self.seen.iterator()}
        for batch in rows:
            for number, limited in zip(batch["attempt"], batch["limited"], strict=True):
                if not pd.isna(number):
                    # an attempt that succeeded once isn't an error
                    attempts[int(number)] = bool(limited) and not pd.isna(limited) and attempts.get(int(number), True)
        if self.stopped.exists():
            at = self.stopped.get()[0]
            yield pd.DataFrame({"task_id": [key[0]], "attempt": [at], "errors": [MOST_ERRORS], "stopped": [True]})
            return
        run, stop = 0, None
        numbers = sorted(attempts)
        for n in numbers:
            run = run + 1 if attempts[n] else 0
            if run == MOST_ERRORS:
                stop = n
                break
        if stop is not None:
            self.stopped.update((stop,))
            self.seen.clear()
            run, last = MOST_ERRORS, stop
        else:
            good = [n for n in numbers if not attempts[n]]
            for n in numbers:
                if good and n < good[-1]:
                    self.seen.removeKey((n,))
                else:
                    self.seen.updateValue((n,), (attempts[n],))
            last = numbers[-1] if numbers else None
        _remind(self.handle, timerValues, self.idle)
        yield pd.DataFrame({"task_id": [key[0]], "attempt": pd.array([last], "Int64"), "errors": [run], "stopped": [stop is not None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.stopped.clear()
        return iter(())

    def close(self) -> None:
        pass


def _remind(handle: StatefulProcessorHandle, timerValues, idle: int | None) -> None:
    """One timer a task, `idle` milliseconds from now."""
    if idle is not None:
        for timer in list(handle.listTimers()):
            handle.deleteTimer(timer)
        handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle)


def best_attempts(results: DataFrame, idle: int | None = None) -> DataFrame:
    """Updates of (task_id, best_reward, best_attempt, next_attempt) from a stream of (task_id, attempt, reward, counted); the last of a task holds. `idle`: milliseconds after which a task's state goes."""
    rows = results.select("task_id", F.col("attempt").cast("long").alias("attempt"), F.col("reward").cast("double").alias("reward"), F.col("counted").cast("boolean").alias("counted"))
    return rows.groupBy("task_id").transformWithStateInPandas(BestAttempt(idle), BEST, "Update", "ProcessingTime" if idle is not None else "None")


def error_runs(results: DataFrame, idle: int | None = None) -> DataFrame:
    """Updates of (task_id, attempt, errors, stopped) from a stream of (task_id, attempt, limited): the run of rate-limit errors that a task is in, and whether one has reached MOST_ERRORS."""
    rows = results.select("task_id", F.col("attempt").cast("long").alias("attempt"), F.col("limited").cast("boolean").alias("limited"))
    return rows.groupBy("task_id").transformWithStateInPandas(ErrorRuns(idle), RUNS, "Update", "ProcessingTime" if idle is not None else "None")
