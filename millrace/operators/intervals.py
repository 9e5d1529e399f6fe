"""Spans and what lies in them, by sorted sweeps: no pairs of a span and a point, or of two spans, are made.

A key (such as a file) with many rows is cut into cells of positions, so that it is spread over as many tasks; a
span goes to each cell that it reaches into.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A cell has about so many rows.
CELL_ROWS = 50_000


def _cells(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, width: how wide the cells are of each key that has more than CELL_ROWS rows."""
    ends = points.select(key, F.col("position").alias("at")).union(spans.select(key, F.col("start").alias("at")))
    sized = ends.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    cells = F.ceil(F.col("n") / CELL_ROWS)
    return sized.where(F.col("n") > CELL_ROWS).select(F.col(key).alias("of"), "low", F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / cells), F.lit(1)).cast("long").alias("width"), (cells - 1).cast("long").alias("last"))


def innermost(points: DataFrame, spans: DataFrame, key: str = "file_path") -> DataFrame:
    """point_id, span_id of the span that starts last among those around a point (start <= position < end), the larger
    id of equal ones; points in no span are left out. points: key, point_id, position; spans: key, span_id, start, end.

    Within a key, spans and points are read in the order of their places, spans first. The open spans
    stand on a stack, which spans that have ended leave when they come to its top: whatever is on top then started last.
    """
    kinds = dict(points.dtypes)["point_id"], dict(spans.dtypes)["span_id"]
    own = spans.where("start < end").where(F.col(key).isNotNull())
    asked = points.where(F.col(key).isNotNull() & F.col("position").isNotNull())
    large = _cells(asked, own, key)
    cell = lambda at: F.when(F.col("of").isNull(), F.lit(0)).otherwise(F.least(F.greatest(F.floor((at - F.col("low")) / F.col("width")), F.lit(0)), F.col("last"))).cast("long")
    a = own.join(large, F.col(key) == F.col("of"), "left").withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    b = asked.join(large, F.col(key) == F.col("of"), "left").withColumn("cell", cell(F.col("position")))
    rows = a.select(key, "cell", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("end"), "span_id", F.lit(None).cast(kinds[0]).alias("point_id"))
    rows = rows.union(b.select(key, "cell", F.col("position").cast("long"), F.lit(1), F.lit(None).cast("long"), F.lit(None).cast(kinds[1]), "point_id"))
    rows = rows.repartition(key, "cell").sortWithinPartitions(key, "cell", "at", "kind", "span_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack = None, []
        for batch in batches:
            found, spans_of = [], []
            columns = (batch.column(c).to_pylist() for c in (key, "cell", "at", "kind", "end", "span_id", "point_id"))
            for k, c, at, kind, end, span, point in zip(*columns, strict=True):
                if (k, c) != last:
                    last, stack = (k, c), []
                if kind == 0:
                    stack.append((end, span))
                    continue
                while stack and stack[-1][0] <= at:
                    stack.pop()
                if stack:
                    found.append(point)
                    spans_of.append(stack[-1][1])
            yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field("point_id").type), pa.array(spans_of, batch.schema.field("span_id").type)], names=["point_id", "span_id"])

    return rows.mapInArrow(run, f"point_id {kinds[0]}, span_id {kinds[1]}")


def contained(spans: DataFrame, key: list[str], ranks: int, cell: int = 4096) -> DataFrame:
    """spans (key, start, end, rank from 0 to ranks - 1) with `inside`: whether one of the same key and at least the same rank
    strictly contains the span. A span that ends before it starts contains none.

    Equal spans become one, with the highest rank; by start, then by the later end, whatever contains a span
    stands before it, so that running maxima of the ends, one per rank, tell. The maxima run within cells of starts and over the cells.
    """
    at = F.floor(F.col("start") / cell)
    ends = [F.when((F.col("top") >= r) & (F.col("end") >= F.col("start")), F.col("end")) for r in range(ranks)]
    one = spans.groupBy(*key, "start", "end").agg(F.max("rank").alias("top")).withColumn("cell", at)
    per_cell = one.groupBy(*key, "cell").agg(*[F.max(e).alias(f"most{r}") for r, e in enumerate(ends)])
    before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.select(*key, "cell", *[F.max(f"most{r}").over(before).alias(f"before{r}") for r in range(ranks)])
    within = Window.partitionBy(*key, "cell").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    one = one.select("*", *[F.max(e).over(within).alias(f"own{r}") for r, e in enumerate(ends)]).join(cells, [*key, "cell"])
    inside = F.array(*[F.coalesce(F.greatest(f"own{r}", f"before{r}") >= F.col("end"), F.lit(False)) for r in range(ranks)])
    return spans.join(one.select(*key, "start", "end", inside.alias("by_rank")), [*key, "start", "end"]).withColumn("inside", F.get("by_rank", F.col("rank"))).drop("by_rank")
