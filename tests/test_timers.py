"""Jobs of a replayed stream fire at their times, each once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import timers

SCHEMA = "job_id string, kind string, at_ms bigint, every_ms bigint, expr string, tz string, enabled boolean, set_at timestamp"
DAY = datetime(2024, 1, 1)


def ms(minutes):
    return int((DAY - datetime(1970, 1, 1)).total_seconds() * 1000) + int(minutes * 60_000)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def run(spark, tmp_path, steps):
    """The stream in files, one for each step, read twice with the same checkpoint: the second start finds only what is new."""
    got = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = timers.fired(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(got)


def test_jobs_fire_once_each(spark, tmp_path):
    tick = lambda m: ("clock", "tick", None, None, None, None, True, at(m))
    steps = [
        [("once", "at", ms(10), None, None, None, True, at(0)), ("often", "every", None, 7 * 60_000, None, None, True, at(0)), ("cron", "cron", None, None, "*/15 * * * *", "UTC", True, at(1)), ("past", "at", ms(-5), None, None, None, True, at(0)), ("off", "every", None, 60_000, None, None, False, at(0)), tick(5)],
        [tick(12)],
        [tick(40)],
        [("often", "every", None, 10 * 60_000, None, None, True, at(41)), ("cron", "cron", None, None, "*/15 * * * *", "UTC", False, at(41)), tick(65)],
    ]
    got = run(spark, tmp_path, steps)
    want = [("once", ms(10)), *(("often", ms(7 * i)) for i in range(1, 6)), ("often", ms(51)), ("often", ms(61)), ("cron", ms(15)), ("cron", ms(30))]
    assert got == sorted(want)


def test_heartbeat(spark, tmp_path):
    """Ticks don't start the job anew."""
    for minutes in ((0, 10, 20), (50,), (125,)):
        spark.createDataFrame([(at(m),) for m in minutes], "set_at timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = []
    stream = timers.fired(timers.heartbeat(spark.readStream.schema("set_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")))
    stream.writeStream.foreachBatch(lambda df, _: got.extend(r.due_ms for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [ms(30), ms(60), ms(90), ms(120)]


@pytest.mark.parametrize("kind, more, after, want", [
    ("at", {"at_ms": 50}, 10, 50), ("at", {"at_ms": 50}, 50, None), ("every", {"every_ms": 5}, 10, 15), ("every", {}, 10, None), ("cron", {"expr": "0 9 * * *", "tz": "UTC"}, ms(0), ms(540)), ("never", {}, 0, None),
])
def test_next_time(kind, more, after, want):
    values = {"at_ms": None, "every_ms": None, "expr": None, "tz": None} | more
    assert timers.next_time(kind, **values, after_ms=after) == want


def test_heartbeat_sees_the_ends_of_a_batch(spark):
    """A job's state is one task's: of many ticks it gets two of each Arrow batch, which fire the same."""
    ticks = spark.range(50_000, numPartitions=2).select(F.timestamp_millis(F.col("id") * 1000).alias("set_at"))
    got = timers.heartbeat(ticks).agg(F.count(F.lit(1)), F.unix_millis(F.min("set_at")), F.unix_millis(F.max("set_at"))).first()
    assert got[0] <= 200 and got[1:] == (0, 49_999_000)
    assert timers.heartbeat(ticks.limit(0)).count() == 0
