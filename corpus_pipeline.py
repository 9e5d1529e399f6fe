"""A training-data pipeline: each stage calls one operator on all that the stage before kept.

Edge cases: rows without text, without letters or with too uncertain a language go at the first stage, so that no later one
sees empty texts; null ids and sources are values like others, and rows without an id are never near copies; of repeated
rows the exact stage keeps one; texts that share an id are told apart by their hash; very long texts pass whole; columns
other than those of documents are dropped; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, language_id, mixing, near_dup, queries
from millrace.llm.common import materialize, shared_dir

#: A text whose language is less certain than this is rejected, and so is one without letters.
LEAST_SCORE = 0.4
#: Chunks that a worker of the last stage remembers: executors still hold what the stages before left in memory.
BPE_MEMO = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS] or docs.columns


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language. The model learns from the labels of the rows that aren't held out."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.select_certain(docs, model, LEAST_SCORE).select(*_like(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_one(docs).select(*_like(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of the smallest id of each group of near copies; documents without words all stay. Texts that share an id
    are judged each by itself."""
    return near_dup.keep_one(docs).select(*_like(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; at the cut, if at least half of it is within. Rows are told
    apart by id, text and source."""
    keys = ("doc_id", "print", "source")
    drawn = mixing.mix(docs, cut="document").where("taken > 0").groupBy(*keys).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    drawn = drawn.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = docs["doc_id"].eqNullSafe(drawn["__doc_id"]) & (F.xxhash64(docs["text"]) == drawn["__print"]) & docs["source"].eqNullSafe(drawn["__source"])
    times = docs.join(drawn, same).withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return times.select(*_like(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return queries.bpe_digests(docs, BPE_MEMO)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's result written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"{folder}/{name}")
    return docs


#: Language scores, hash draws and BPE have no SQL form here; the tests run the stages against brute force.
ORACLE_SQL = None
