"""Streams: incremental re-indexing, message routing, run and task states, hidden summaries, sessions.

An answer that arrives in pieces is a stream of chunks here (R01); how it reaches a client is not (R03).

All run on Structured Streaming with a checkpoint in a shared folder; sinks are idempotent per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import versions


def file_events(spark, folder: str, schema: str, files_per_step: int = 1000) -> DataFrame:
    """A stream of a folder's new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).json(folder)


def incremental(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """Runs apply(changed files, step) for each micro-batch (R06): the caller upserts what it parses of them."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def reindex_step(old_manifest: DataFrame, scanned: DataFrame, old_elements: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(elements, changes) after a scan: only added and modified files are parsed, elements of unchanged ones are
    kept, those of deleted ones go (R06, J31, J32, Z22)."""
    changes = versions.file_changes(old_manifest, scanned)
    todo = scanned.join(changes.where("status in ('added', 'modified')").select("path"), "path", "left_semi")
    kept = versions.unchanged_elements(old_elements, old_manifest, changes)
    return kept.unionByName(parse(todo), allowMissingColumns=True), changes


def route(stream: DataFrame, channels: list[str], checkpoint: str, sink: Callable[[str, DataFrame, int], None]):
    """Hands each channel its rows, micro-batch by micro-batch."""

    def each(rows: DataFrame, step: int) -> None:
        rows.persist()
        for c in channels:
            sink(c, rows.where(F.col("channel") == c), step)
        rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def allowed(stream: DataFrame, senders: dict[str, list[str]]) -> DataFrame:
    """Messages of senders that their channel allows; a channel without a list allows all."""
    test: Column = F.lit(True)
    for channel, names in senders.items():
        test = F.when(F.col("channel") == channel, F.col("sender").isin(*names)).otherwise(test)
    return stream.where(test)


def deduplicated_runs(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Runs without repeats of an idempotency key within the delay."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def task_states(stream: DataFrame) -> DataFrame:
    """task_id, status, attempts of a stream of task events, kept without expiry (R07); for output mode update."""
    return stream.groupBy("task_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.count_if(F.col("status") == "running").alias("attempts"), F.max("at").alias("updated_at"))


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """user_id, session start and end, events: an extension on event time with a watermark."""
    return stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


OPEN, CLOSE = "<SUMMARY>", "</SUMMARY>"


def visible(buffer: str, hidden: bool, chunk: str) -> tuple[str, str, bool]:
    """(shown, buffer, hidden) after a chunk of an answer: what stands between the tags is hidden, tags may be cut by
    chunk borders (R02)."""
    text, shown = buffer + chunk, ""
    capitals = lambda t: t.encode(errors="surrogatepass").upper().decode(errors="surrogatepass")  # noqa: E731  a-z only: lengths stay
    while True:
        tag = CLOSE if hidden else OPEN
        at = capitals(text).find(tag)
        if at >= 0:
            shown += "" if hidden else text[:at]
            text, hidden = text[at + len(tag) :], not hidden
            continue
        keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(capitals(text[-n:]))), 0)
        shown += "" if hidden else text[: len(text) - keep]
        return shown, text[len(text) - keep :], hidden


def hide_summaries(stream: DataFrame) -> DataFrame:
    """session_id, shown for chunks (session_id, ord, chunk) of answers that arrive in pieces; a null chunk ends an answer:
    what was held back as the possible start of a tag is shown then, and the session starts anew (R02)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, hidden = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for chunk in rows["chunk"]:
            if chunk is None or chunk != chunk:
                out.append("" if hidden else buffer)
                buffer, hidden = "", False
                continue
            shown, buffer, hidden = visible(buffer, hidden, chunk)
            out.append(shown)
        state.update((buffer, hidden))
        yield pd.DataFrame({"session_id": [key[0]], "shown": ["".join(out)]})

    return stream.groupBy("session_id").applyInPandasWithState(step, "session_id string, shown string", "buffer string, hidden boolean", "append", GroupStateTimeout.NoTimeout)


def heartbeat_due(note: str | None) -> bool:
    """Whether a heartbeat file has a task: anything but headings, comments, blanks and empty boxes."""
    return any(x.strip() and not x.strip().startswith(("#", "<!--", "- [x]")) and x.strip() not in ("- [ ]", "* [ ]") for x in (note or "").split("\n"))
