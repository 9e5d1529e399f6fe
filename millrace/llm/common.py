"""Helpers that the operators of this subpackage share: work folders, tables written there, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

#: Characters that separate words, as the contracts of these operators define them.
SPACE = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.encode().lower().decode()


def ascii_lower_col(column):
    return F.translate(column, _UPPER, _LOWER)


def words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, in UTF-8: bytes are lower-cased and split by exactly these rules."""
    return text.encode().lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach.

    The cluster names its shared folder in spark.checkpoint.dir. Where that is
    unset, a local master (tests) gets a temporary folder, and a cluster its
    warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str, partition_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet under a shared folder and reads it back: lineage ends there,
    so a lost executor costs no recomputation of what came before."""
    writer = df.write.mode("errorifexists")
    if partition_bytes:
        writer = writer.option("parquet.block.size", partition_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024, mb: int = 16) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones, whatever their names, stay out of the operator's way."""
    return docs.select(*[docs[n].alias(n) for n in names])


def default_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine (every worker has the same package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache(key, make, _kept={}):
    """One object per Python worker, made at first use and kept until an operator asks for another: the memos of
    several operators that follow each other don't add up."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            _give_back()
        _kept[key] = make()
    return _kept[key]


def _give_back() -> None:
    """Returns freed memory to the system where the C library can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def local_file(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(f"vocabulary file {path} is not on this machine")
    return path
