"""Versioned tables: latest rows, upserts, publication, change detection, runs and tasks, dialogue, caches, schedules.

An upsert is a union and the last row per key: the caller writes the result as the next version of the table.
Timestamps are timestamps; ties of time go to the larger id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key; null keys are keys too."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if isinstance(o, Column) else F.desc(o) for o in order])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# -- upserts ------------------------------------------------------------------------
def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace those of their key; columns of keep_first keep their oldest value."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(*keys)
    for c in keep_first:
        both = both.withColumn(c, F.min_by(c, "__new").over(own))
    return latest(both, keys, ["__new"]).drop("__new")


def only_new(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there, one for each key; null keys are equal."""
    seen = table.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    condition = None
    for k in keys:
        test = new[k].eqNullSafe(seen[f"__{k}"])
        condition = test if condition is None else condition & test
    return new.dropDuplicates(keys).join(seen, condition, "left_anti")


def insert_new(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table and the new rows whose key isn't there."""
    return table.unionByName(only_new(table, new, keys), allowMissingColumns=True)


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows of some keys, such as a session's turns."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


# -- publication ------------------------------------------------------------------------
def with_previous(manifests: DataFrame) -> DataFrame:
    """previous_manifest_id of each manifest of a repository's ref."""
    w = Window.partitionBy("repo_name", "ref_name").orderBy("published_at", "manifest_id")
    return manifests.withColumn("previous_manifest_id", F.lag("manifest_id").over(w))


def heads(manifests: DataFrame) -> DataFrame:
    """The head of each ref: its last manifest."""
    return latest(manifests, ["repo_name", "ref_name"], ["published_at", "manifest_id"])


def publish(manifests: DataFrame, new: DataFrame) -> DataFrame:
    """The log with a new manifest, previous pointers set; its head follows from the log, so both change at once."""
    return with_previous(manifests.drop("previous_manifest_id").unionByName(new.drop("previous_manifest_id"), allowMissingColumns=True))


def published(manifests: DataFrame, new: DataFrame) -> DataFrame:
    """New manifests with previous_manifest_id: of each ref, the first points to the head, the others each to the one before."""
    ends = heads(manifests).withColumn("__new", F.lit(False)).unionByName(new.drop("previous_manifest_id").withColumn("__new", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("repo_name", "ref_name").orderBy("__new", "published_at", "manifest_id")
    found = ends.withColumn("previous_manifest_id", F.lag("manifest_id").over(w)).where("__new").drop("__new")
    return found.select(manifests.columns)


def branch_manifest(head_rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Heads joined with their manifests."""
    return head_rows.select("repo_name", "ref_name", "manifest_id").join(manifests.drop("repo_name", "ref_name"), "manifest_id")


def resolve_snapshot(asked: DataFrame, manifests: DataFrame) -> DataFrame:
    """asked (repo_name, ref_name, snapshot_id) with the given id, else the head's."""
    h = heads(manifests).select("repo_name", "ref_name", F.col("snapshot_id").alias("__head"))
    return asked.join(h, ["repo_name", "ref_name"], "left").withColumn("snapshot_id", F.coalesce("snapshot_id", "__head")).drop("__head")


# -- files ----------------------------------------------------------------------------
def file_changes(old: DataFrame, new: DataFrame, key: str = "path", compared: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """key, status: added, modified, deleted or unchanged."""
    a, b = old.select(key, F.struct(*compared).alias("__old")), new.select(key, F.struct(*compared).alias("__new"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def unchanged_elements(elements: DataFrame, file_manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The elements of unchanged files (J32). file_manifest: path, element_ids."""
    ids = file_manifest.join(changes.where("status = 'unchanged'").select("path"), "path", "left_semi").select(F.explode("element_ids").alias("id"))
    return elements.join(ids, "id", "left_semi")


def file_manifest(files: DataFrame, elements: DataFrame) -> DataFrame:
    """path, mtime, size, element_ids."""
    ids = elements.groupBy(F.col("relative_path").alias("path")).agg(F.array_sort(F.collect_list("id")).alias("element_ids"))
    return files.select("path", "mtime", "size").join(ids, "path", "left").withColumn("element_ids", F.coalesce("element_ids", F.array().cast("array<string>")))


# -- runs and tasks ------------------------------------------------------------------------
def create_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with new ones, but for those whose idempotency key is there already."""
    return insert_new(runs, new.where("idempotency_key is not null"), ["idempotency_key"]).unionByName(new.where("idempotency_key is null"), allowMissingColumns=True)


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run from its log: last status, when it was created, started and completed."""
    done = F.col("status").isin("succeeded", "degraded", "published", "failed")
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.min("at").alias("created_at"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(done, F.col("at"))).alias("completed_at"), F.max_by("error_message", F.struct("at", "event_id")).alias("error_message"))


def task_states(events: DataFrame) -> DataFrame:
    """task_id, status, attempts (how often it ran), updated_at, created_at."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.count_if(F.col("status") == "running").alias("attempts"), F.max("at").alias("updated_at"), F.min("at").alias("created_at"))


def claim(tasks: DataFrame) -> DataFrame:
    """The oldest pending task as it is after the claim: running, one attempt more."""
    return tasks.where("status = 'pending'").orderBy("created_at", "task_id").limit(1).withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def retry_summary(results: DataFrame) -> DataFrame:
    """processed, succeeded, failed."""
    return results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


# -- dialogue -----------------------------------------------------------------------------
def last_turns(turns: DataFrame, n: int, session: str = "session_id", turn: str = "turn_number") -> DataFrame:
    """Turns whose number is among the last n, oldest first; missing ones leave gaps."""
    most = Window.partitionBy(session)
    return turns.withColumn("__m", F.max(turn).over(most)).where(F.col(turn) > F.col("__m") - n).drop("__m").orderBy(session, turn)


def last_messages(messages: DataFrame, n: int = 50, session: str = "session_id", order: str = "ord") -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r").orderBy(session, order)


def next_turn(turns: DataFrame, session: str = "session_id", turn: str = "turn_number") -> DataFrame:
    """The number of each session's next turn."""
    return turns.groupBy(session).agg((F.coalesce(F.max(turn), F.lit(0)) + 1).alias("next_turn"))


def session_index(turns: DataFrame) -> DataFrame:
    """session_id, total_turns, created_at, last_updated, multi_turn (sticky)."""
    return turns.groupBy("session_id").agg(F.max("turn_number").alias("total_turns"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("last_updated"), F.bool_or("multi_turn").alias("multi_turn"))


def session_list(index: DataFrame, turns: DataFrame, most: int = 80) -> DataFrame:
    """Sessions with the first question as their title, newest first."""
    from ..functions.text import title

    first = earliest(turns, ["session_id"], ["turn_number"]).select("session_id", title(F.col("query"), most).alias("title"))
    return index.join(first, "session_id", "left").orderBy(F.desc("created_at"), F.desc("last_updated"), "session_id")


def recent_notes(notes: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Notes of the last days, newest first (W24). notes: date, text."""
    return notes.where((F.col("date") > F.date_sub(today, days)) & (F.col("date") <= today)).orderBy(F.desc("date"))


# -- caches ---------------------------------------------------------------------------------
def cache_put(table: DataFrame, new: DataFrame, seconds: int = 3600) -> DataFrame:
    """new: key, value, stored_at."""
    from .. functions.values import expires_at

    return upsert(table, new.withColumn("expires_at", expires_at(F.col("stored_at"), seconds)), ["key"])


def cache_get(table: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The values of keys that are there and fresh."""
    return keys.select("key").join(table.where(now < F.col("expires_at")), "key")


def cache_stats(table: DataFrame, now: Column) -> DataFrame:
    """entries, bytes, expired."""
    return table.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"), F.count_if(now >= F.col("expires_at")).alias("expired"))


# -- schedules --------------------------------------------------------------------------------
def due_jobs(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Enabled jobs whose time has come."""
    return jobs.where(F.col("enabled") & (F.col("next_run_at_ms") <= now_ms)).orderBy("next_run_at_ms", "id")


def next_wake(jobs: DataFrame) -> DataFrame:
    return jobs.where("enabled").agg(F.min("next_run_at_ms").alias("next_wake_ms"))


def listed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("next_run_at_ms").asc_nulls_last(), "id")


def orphans(indexes: DataFrame, metadata: DataFrame) -> DataFrame:
    """name, problem, megabytes of index files without metadata and the other way round (Z01). Both: name, size."""
    a, b = indexes.select("name", F.col("size").alias("sa")), metadata.select("name", F.col("size").alias("sb"))
    x = a.join(b, "name", "full_outer").where("sa is null or sb is null")
    return x.select("name", F.when(F.col("sb").isNull(), "index without metadata").otherwise("metadata without index").alias("problem"), (F.coalesce("sa", "sb") / 1048576).alias("megabytes"))
