"""Registered queries that replay a table as a stream: timers, routes, hidden parts of answers, changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph as G
from .queries import documents, registered, table
from .streaming import streams, timers


def _replayed(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All rows that a streaming query gives for the parts, each of which arrives before a start of its own on one checkpoint."""
    folder = G.work_folder(spark)

    def keep(rows: DataFrame, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/step={step}")  # a step that is run again replaces what it wrote

    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _halves(rows: DataFrame, at: str) -> list[DataFrame]:
    middle = rows.agg((F.min(F.unix_millis(at)) + F.max(F.unix_millis(at))).alias("m")).first().m // 2
    return [rows.where(F.unix_millis(at) <= middle), rows.where(F.unix_millis(at) > middle)]


@registered("""with jobs as (select user_id, (10 + user_id % 5) * 3600000 as every_ms, min(epoch_us(ts) // 1000) as first_ms from events group by user_id), clock as (select max(epoch_us(ts) // 1000) as now from events)
    select 'u' || user_id as job_id, first_ms + every_ms * unnest(range(1, (now - first_ms) // every_ms + 1)) as due_ms from jobs, clock""")
def fired_jobs(spark, sf_dir):
    """A job for each user from their first event on; all events move the clock."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    job = lambda rows, name, kind, every, at: rows.select(name.alias("job_id"), F.lit(kind).alias("kind"), none.alias("at_ms"), every.cast("long").alias("every_ms"), text.alias("expr"), text.alias("tz"), F.lit(True).alias("enabled"), F.col(at).alias("set_at"))
    users = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    jobs = job(users, F.concat(F.lit("u"), "user_id"), "every", (10 + F.col("user_id") % 5) * 3_600_000, "first")
    rows = jobs.union(job(e, F.lit("clock"), "tick", none, "ts"))
    return _replayed(spark, _halves(rows, "set_at"), timers.fired).select("job_id", "due_ms")


@registered("""with t as (select epoch_us(min(ts)) // 1000 as first_ms, epoch_us(max(ts)) // 1000 as now from events)
    select 'heartbeat' as job_id, first_ms + 1800000 * unnest(range(1, (now - first_ms) // 1800000 + 1)) as due_ms from t""")
def heartbeats(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("set_at"))
    return _replayed(spark, _halves(ticks, "set_at"), lambda s: timers.fired(timers.heartbeat(s))).select("job_id", "due_ms")


@registered("select conv_id::varchar as session_id, md5(string_agg(text, '' order by turn)) as shown from (select conv_id, turn, min(text) as text from conversations group by all) group by conv_id")
def hidden_summaries(spark, sf_dir):
    """Each turn is a chunk of its conversation's answer, with a hidden part around its end that the next chunk closes."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    own = Window.partitionBy("conv_id")
    first, last = F.col("turn") == F.min("turn").over(own), F.col("turn") == F.max("turn").over(own)
    hidden = F.concat(F.when(first, F.lit("")).otherwise(F.lit("y</SUMMARY>")), "text", F.when(last, F.lit("")).otherwise(F.lit("<summary>x")))
    chunks = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("ord"), hidden.alias("chunk"))
    parts = [chunks.where("ord < 2"), chunks.where("ord >= 2")]
    shown = _replayed(spark, parts, streams.hide_summaries).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "shown"))), lambda x: x["shown"]), "").alias("all"))
    return shown.select("session_id", F.md5(F.col("all").cast("binary")).alias("shown"))


@registered("select lang as channel, count(*) as n, sum(length(text))::bigint as chars from documents where lang <> 'de' or source = 'src1' group by lang")
def routed_messages(spark, sf_dir):
    """Documents as messages in their language's channel; one channel allows a single sender."""
    rows = documents(spark, sf_dir).where("lang is not null and text is not null").select(F.col("lang").alias("channel"), F.col("source").alias("sender"), F.col("text").alias("content"))
    folder = G.work_folder(spark)
    rows.write.parquet(f"{folder}/in")
    stream = streams.allowed(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), {"de": ["src1"]})
    sink = lambda channel, part, step: part.write.mode("overwrite").parquet(f"{folder}/out/name={channel}/step={step}")
    channels = [r.channel for r in rows.select("channel").distinct().limit(1000).collect()]
    streams.route(stream, channels, f"{folder}/checkpoint", sink).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@registered("""select case when doc_id % 5 = 1 then 'new' else 'old' end || doc_id as id, case when doc_id % 5 = 1 then 'modified' else 'unchanged' end as status from documents where doc_id % 5 > 0 and doc_id % 7 > 0
    union all select 'new' || doc_id, 'added' from documents where doc_id % 5 = 0 and doc_id % 7 > 0""")
def reindexed_elements(spark, sf_dir):
    """Of the files, a fifth is new, a fifth changed and a seventh gone: only those are parsed."""
    d = documents(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("path"), "doc_id", F.length("text").cast("long").alias("size"))
    at = F.timestamp_seconds(F.col("doc_id"))
    old = d.where("doc_id % 5 > 0").select("path", at.alias("mtime"), "size", F.array(F.concat(F.lit("old"), "doc_id")).alias("element_ids"))
    seen = d.where("doc_id % 7 > 0").select("path", F.when(F.col("doc_id") % 5 == 1, F.timestamp_seconds(F.col("doc_id") + 1)).otherwise(at).alias("mtime"), "size")
    elements = d.where("doc_id % 5 > 0").select(F.concat(F.lit("old"), "doc_id").alias("id"), "path")
    got, changes = streams.reindex_step(old, seen, elements, lambda todo: todo.select(F.concat(F.lit("new"), F.substring_index("path", "/", -1)).alias("id"), "path"))
    return got.join(changes, "path").select("id", "status")
