"""Timers: jobs of a stream that fire when the clock of the stream passes their time.

Each job is a key with state of its own and one timer. The clock is the watermark of the stream's rows, jobs and other rows
alike, so a stream that is read again fires the same jobs at the same times, however it is cut into micro-batches.
A job of kind "at" fires once and its state goes; "every" and "cron" jobs fire at each of their times. A newer row of a job
replaces it, unless it says the same; one that isn't enabled ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.values import next_cron

HEARTBEAT_MS = 30 * 60 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_time(kind: str, at_ms: int | None, every_ms: int | None, expr: str | None, tz: str | None, after_ms: int) -> int | None:
    """The first time of a job after the given one; null if there is none."""
    if kind == "at":
        return at_ms if at_ms is not None and at_ms > after_ms else None
    if kind == "every":
        return after_ms + every_ms if every_ms and every_ms > 0 else None
    if kind == "cron" and expr:
        found = next_cron(expr, datetime.fromtimestamp(after_ms / 1000, UTC), tz or "UTC")
        return None if found is None else int(found.timestamp() * 1000)
    return None


class _Jobs(StatefulProcessor):
    """The state of a job: what it is, and when it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = (("kind", StringType()), ("at_ms", LongType()), ("every_ms", LongType()), ("expr", StringType()), ("tz", StringType()), ("due_ms", LongType()))
        self.job = handle.getValueState("job", StructType([StructField(n, t) for n, t in kinds]))

    def _wait(self, job: tuple | None, due: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is None:
            self.job.clear()
        else:
            self.job.update((*job, due))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda x: None if x is None or x != x else x
        number = lambda x: None if plain(x) is None else int(x)
        held = tuple(self.job.get())[:-1] if self.job.exists() else None
        job, since = held, None
        for r in pd.concat(list(rows)).sort_values("set_ms", kind="stable").itertuples():
            if r.kind == "tick":
                continue
            said = (r.kind, number(r.at_ms), number(r.every_ms), plain(r.expr), plain(r.tz)) if r.enabled else None
            if said != job:
                job, since = said, int(r.set_ms)
        if since is not None:
            self._wait(job, next_time(*job, since) if job else None)
        yield pd.DataFrame({"job_id": pd.Series(dtype=object), "due_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, fired = expiredTimerInfo.getExpiryTimeInMs(), []
        *job, known = self.job.get()
        now = max(timerValues.getCurrentWatermarkInMs(), due)
        while due is not None and due <= now:  # all times that the clock has passed
            fired.append(due)
            due = next_time(*job, due)
        self._wait(tuple(job), due)
        yield pd.DataFrame({"job_id": [key[0]] * len(fired), "due_ms": fired})

    def close(self) -> None:
        pass


def fired(jobs: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """job_id, due_ms of each time that a job fires. jobs: a stream of job_id, kind (at, every, cron; tick moves the clock only),
    at_ms, every_ms, expr, tz, enabled, set_at (when the row counts from)."""
    spark = jobs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = jobs.withColumn("set_ms", F.unix_millis("set_at")).withWatermark("set_at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(), "job_id string, due_ms bigint", "Append", "EventTime")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last time of each batch."""
    for b in batches:
        ends = pc.min_max(b.column(0))
        if ends["min"].is_valid:
            yield pa.RecordBatch.from_arrays([pa.array([ends["min"].as_py(), ends["max"].as_py()], b.schema.field(0).type)], names=["set_at"])


def heartbeat(ticks: DataFrame, every_ms: int = HEARTBEAT_MS, job_id: str = "heartbeat") -> DataFrame:
    """Rows for fired(), from a stream's ticks (set_at), of one job that fires every so often from the first tick on. All rows
    say the same, so that of each batch of ticks the first, which may set the job, and the last, which moves the clock, are
    all that the job's single state sees."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    ends = ticks.select(F.col("set_at").cast("timestamp").alias("set_at")).mapInArrow(_ends, "set_at timestamp")
    return ends.select(F.lit(job_id).alias("job_id"), F.lit("every").alias("kind"), none.alias("at_ms"), F.lit(every_ms).cast("long").alias("every_ms"), text.alias("expr"), text.alias("tz"), F.lit(True).alias("enabled"), "set_at")
