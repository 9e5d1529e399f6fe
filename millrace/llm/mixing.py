"""Mixing sources to target weights, in DataFrame functions only.

Targets: the sources, by code point with null last, weigh WEIGHTS, repeating,
and share SHARE of all sizes; a target stops at MOST times its source's size
and the excess goes to the others by weight. That is water-filling: with the
sources ordered by what they can hold per weight, the level comes from prefix
sums in one pass.

Draw: every document has a key, a hash of its id, its text and the seed. Within a source
the documents stand by that key, which is the same as shuffling them. The top
bits of the key cut each source into ranges; sums of ranges, then of documents
within a range, give each document's place in the source by words, so a source
that holds a third of all rows is spread over as many tasks as it has ranges.
Whole epochs are taken first; the rest is cut at the exact budget.

Edge cases: null texts and texts without words have size 0 and are never drawn;
a source of size 0 has target 0; repeated document ids count each for itself;
an empty table gives an empty result; extra columns are left out; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, shared_dir, with_columns_of

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Ranges per source, by the top bits of the key.
RANGE_BITS = 10


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, print: the words and xxhash64 of each row's text."""
    rows = with_columns_of(docs, id_col, text_col, source_col)
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    return rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.alias("size"), F.xxhash64(text_col).alias("print"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from source, source_size: a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    x = per_source.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source that can hold what the level gives it fixes the level for itself and all after it.
    holds = F.col("level") * F.col("weight") <= F.col("cap")
    x = x.withColumn("fixed", F.first(F.when(holds, F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select("source", "source_size", F.least(F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, cut: str = "word") -> DataFrame:
    """doc_id, print (xxhash64 of the text), source, size, source_size, target, taken for each row of docs.

    taken: words that the mix takes, repeats counted. cut="word": the document at the cut gives only
    its part, so that a source gives its target to the word; cut="document": it is taken whole if at
    least half of it is within.

    Shuffles: the sums by range (pre-aggregated in each task), and each row's id, source and
    size once, by source and range; texts never.
    """
    if cut not in ("word", "document"):
        raise ValueError(f"cut: {cut}")
    key = F.xxhash64(F.col("doc_id"), F.col("print"), F.lit(seed))
    counted = materialize(sizes(docs, id_col, text_col, source_col), f"{shared_dir(docs.sparkSession)}/sizes")  # texts are read once
    rows = counted.withColumn("key", key).withColumn("range", F.shiftright(F.col("key"), 64 - RANGE_BITS).cast("int"))
    spread = rows.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name")).alias("group"), "doc_id", "source", "size", "print", "key", "range")
    ranges = spread.groupBy("group", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    per_source = ranges.groupBy("group").agg(F.sum("range_size").alias("source_size"))
    per_source = per_source.select("group", F.when(~F.col("group.none"), F.col("group.name")).alias("source"), "source_size")
    goal = targets(per_source.select("source", "source_size"), weights, share, most)
    goal = goal.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name")).alias("group"), "source_size", "target")
    plan = ranges.join(goal, "group").select("group", "range", "ahead", "source_size", "target")
    within = Window.partitionBy("group", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("upto", F.sum("size").over(within)).join(plan, ["group", "range"])
    words = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - epochs * F.col("source_size")
    inside = F.least(F.greatest(rest - (F.col("ahead") + F.col("upto") - F.col("size")), F.lit(0)), F.col("size"))
    if cut == "document":
        inside = F.when(inside * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return placed.select("doc_id", "print", "source", "size", "source_size", "target", (epochs * F.col("size") + inside).cast("long").alias("taken"))
