"""Retries with back-off as a stateful stream: one timer a document, in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds before the first retry, doubled each time, and how many there are.
BASE_SECONDS, MOST = 60, 3
#: What the watermark counts as a millisecond: pandas has nanoseconds, which end in 2262.
TICK = 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kind ``retry`` is due at ``at``; kind ``given_up`` tells of the failure after the last one.
SCHEMA = "document_id string, kind string, attempt long, ms long"


def advanced(sent: list[tuple[int, str]], failures: int, due: int, base: int, most: int) -> tuple[int, int, list[tuple[str, int, int]]]:
    """A document's outcomes (at, status) in order of time on its state: failures so far
    and when its waiting retry is due (0: none), both as after them, and what came due.

    A failure starts a wait; one that comes while a retry is waiting is the same failure."""
    out: list[tuple[str, int, int]] = []
    for at, status in sorted(sent):
        if due and due <= at:
            out.append(("retry", failures, due))
            due = 0
        if status == "completed":
            failures, due = 0, 0
        elif not due and failures < most:
            due, failures = at + base * 2**failures, failures + 1
        elif not due:
            out.append(("given_up", failures, at))
            failures = 0
    return failures, due, out


def _pairs(sent: pd.DataFrame) -> list[tuple[int, str]]:
    return [(v >> 1, "failed" if v & 1 else "completed") for v in sent["sent"].tolist()]


def _rows(key: str, out: list[tuple[str, int, int]]) -> pd.DataFrame:
    kinds, attempts, at = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"document_id": [key] * len(out), "kind": list(kinds), "attempt": np.array(attempts, np.int64), "ms": np.array(at, np.int64)})


def _step(base: int, most: int):
    """``advanced`` on state that Spark sends and takes back with a task's rows, and a timeout
    when the retry is due; a completed document, and one that has been given up, has no
    state."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, due = state.getOption or (0, 0)
        sent = [] if state.hasTimedOut else [p for part in rows for p in _pairs(part)]
        failures, due, out = advanced(sent, failures, due, base, most)
        # what is due by now does not wait: outcomes that come later are later than it
        if due and due <= state.getCurrentWatermarkMs() * TICK:
            out.append(("retry", failures, due))
            due = 0
        if failures:
            state.update((failures, due))
            if due:
                state.setTimeoutTimestamp(-(-due // TICK))
        elif state.exists:
            state.remove()
        if out:
            yield _rows(key[0], out)

    return run


def use_timers(spark: SparkSession) -> None:
    """Waiting documents are kept on disk, not in the executors' memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _outcomes(rows: DataFrame) -> DataFrame:
    """Times go to Python as milliseconds, with the status as their last bit: a timestamp
    would there be one of nanoseconds, and each column costs time for each document."""
    rows = rows.where("document_id is not null and at is not null and status in ('failed', 'completed')").withColumn("at", F.col("at").cast("timestamp"))
    sent = F.unix_millis("at") * 2 + (F.col("status") == "failed").cast("long")
    return rows.select(F.col("document_id").cast("string").alias("document_id"), sent.alias("sent"), F.timestamp_millis(F.unix_seconds("at")).alias("clock"))


def _ticks(spark: SparkSession, late: str) -> str:
    """``late`` on the clock, and a tick more: what it lets through is let through there."""
    ms = spark.sql("select unix_millis(timestamp_millis(0) + cast(:late as interval)) as ms", args={"late": late}).first().ms
    return f"{-(-ms // TICK) + 1} milliseconds"


def _due(told: DataFrame) -> DataFrame:
    return told.withColumn("ms", F.timestamp_millis("ms")).withColumnRenamed("ms", "at")


def retry_stream(outcomes: DataFrame, late: str = "1 minute", base_seconds: int = BASE_SECONDS, most: int = MOST) -> DataFrame:
    """Retries that are due, from a stream (document_id, status, at) of failed and completed
    attempts: failure number n is retried ``base_seconds * 2 ** (n - 1)`` later, once the
    watermark has passed that time, and ``most`` times at most.  The watermark counts whole
    seconds and is behind by ``late`` and up to two of them.

    State and timers are in Spark's checkpoint, so a batch that is lost is run again with
    the state from before it; outcomes that are later than the watermark are dropped."""
    rows = _outcomes(outcomes).withWatermark("clock", _ticks(outcomes.sparkSession, late))
    return _due(rows.groupBy("document_id").applyInPandasWithState(_step(base_seconds * 1000, most), SCHEMA, "failures long, due long", "append", GroupStateTimeout.EventTimeTimeout))


def retries(outcomes: DataFrame, base_seconds: int = BASE_SECONDS, most: int = MOST) -> DataFrame:
    """The same of a table that is complete, one document's outcomes at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        failures, due, out = advanced(_pairs(rows), 0, 0, base_seconds * 1000, most)
        return _rows(rows["document_id"].iloc[0], [*out, *([("retry", failures, due)] if due else [])])

    return _due(_outcomes(outcomes).drop("clock").groupBy("document_id").applyInPandas(run, SCHEMA))
