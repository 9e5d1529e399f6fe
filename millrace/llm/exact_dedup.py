"""Exact dedup as a stateful stream, in DataFrame functions only.

Each document gives a small record: digest of its normalised text, stable
identifier, length and content locator (the file it was read from). The records
pass as a stream into keyed state on disk (RocksDB), which never expires: per
digest it retains the count, and of the row that stays the identifier and the
locator. A digest that was hit again is only a claim: the full normalised bytes
of all rows of such digests are compared, and rows that differ under one digest
are grouped by their bytes instead.

Edge cases: null counts as the empty text, and all texts without characters
other than white space are one group; of equal texts the one with the most code
points stays, then the smallest id, then (repeated ids) one of the rows; null ids
lose to others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, shared_dir, with_columns_of

#: Files of records per micro-batch: what one step of the stream takes in.
FILES_PER_STEP = 2048
#: Digests that were hit are broadcast for the check of the full bytes up to this many, else joined by shuffle.
BROADCAST_KEYS = 100_000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # the state is on disk; a store's memory goes back after each step
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalised(text: Column) -> Column:
    """The text without any character of [space, tab to carriage return]; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_chars, text_sha256, locator: all that the state needs to know of a document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.input_file_name().alias("locator"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), "locator")


def _retained(keyed: DataFrame) -> DataFrame:
    """What the state holds per key. The largest struct is the row that stays."""
    stays = F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), "locator")
    return keyed.groupBy("key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("group_size"))


def deduplicate_stream(stream: DataFrame, folder: str, key_hex: int = 64, trigger: dict | None = None) -> list[str]:
    """Runs a stream of records through the keyed state under folder; further runs go on from there.

    Returns the folders of the updates, in order: per step, the state of each key that it touched.
    """
    spark, done = stream.sparkSession, []

    def save(updates: DataFrame, step: int) -> None:
        updates.write.mode("overwrite").parquet(f"{folder}/updates/step={step}")
        done.append(f"{folder}/updates/step={step}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        keyed = stream.withColumn("key", F.substring("text_sha256", 1, key_hex))
        query = _retained(keyed).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return done


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_hex: int = 64, files_per_step: int = FILES_PER_STEP) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars, locator (of the row that stays).

    key_hex: characters of the digest that key the state; fewer only make the check of the full bytes work more.
    Texts are shuffled only where their digest was hit, and then once per task and distinct text.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    seen = materialize(records(docs, id_col, text_col), f"{folder}/records")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", files_per_step).parquet(f"{folder}/records")
    steps = deduplicate_stream(stream, folder, key_hex)
    schema = _retained(seen.withColumn("key", F.substring("text_sha256", 1, key_hex))).schema
    state = spark.read.schema(schema).parquet(*steps) if steps else spark.createDataFrame([], schema)
    if len(steps) > 1:  # the last update of a key has its largest count
        state = state.groupBy("key").agg(F.max(F.struct("group_size", "stays")).alias("last")).select("key", "last.stays", "last.group_size")

    keyed = seen.withColumn("key", F.substring("text_sha256", 1, key_hex))
    result = keyed.join(state, "key").select("key", "doc_id", (-F.col("stays.minus_id")).alias("keep_id"), "group_size", (F.col("row") == -F.col("stays.minus_row")).alias("kept"), "text_sha256", "n_chars", "stays.locator")

    hits = materialize(state.where(F.col("group_size") > 1).select("key"), f"{folder}/hits")
    few = hits.count() <= BROADCAST_KEYS
    texts = with_columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("bytes"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    texts = texts.withColumn("text_sha256", F.sha2("bytes", 256)).withColumn("key", F.substring("text_sha256", 1, key_hex))
    distinct = texts.join(F.broadcast(hits) if few else hits, "key", "left_semi").groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("n"))
    differ = materialize(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1).select("key"), f"{folder}/differ")
    if differ.isEmpty():
        return result.drop("key")
    same = Window.partitionBy("key", "bytes")
    order = same.orderBy(F.desc("n_chars"), F.col("doc_id").asc_nulls_last())
    by_bytes = texts.join(differ, "key", "left_semi").select("doc_id", F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), "text_sha256", "n_chars", F.lit("").alias("locator"))
    return result.join(differ, "key", "left_anti").drop("key").unionByName(by_bytes)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of equal texts."""
    def place(doc_id, sha, n):
        return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("~")), sha, n.cast("string"))

    stay = deduplicate(docs, id_col, text_col).where("kept").select(place(F.col("doc_id"), F.col("text_sha256"), F.col("n_chars")).alias("__place")).distinct()
    own = docs.withColumn("__place", place(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256), F.length(F.coalesce(F.col(text_col), F.lit("")))))
    return own.join(stay, "__place", "left_semi").dropDuplicates(["__place"]).drop("__place")
