"""Sweeps over spans against loops over all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.operators import resolve as R


@pytest.mark.parametrize("cell_rows", [50_000, 7])
def test_innermost(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(intervals, "CELL_ROWS", cell_rows)
    rnd = random.Random(cell_rows)
    spans = [(rnd.choice("abc"), f"s{i:03}", (a := rnd.randrange(80)), a + rnd.randrange(-2, 30)) for i in range(90)] + [("d", "s0", 0, 10), ("e", "long", 0, 10_000), (None, "n", 0, 99)]
    points = [(rnd.choice("abcdf"), i, rnd.randrange(120)) for i in range(250)] + [(None, 900, 5), ("a", 901, None), ("e", 902, 9_999), ("e", 903, 10_000)] + [("e", 1000 + i, i * 31) for i in range(20)]
    got = {r.point_id: r.span_id for r in intervals.innermost(spark.createDataFrame(points, "file_path string, point_id int, position long"), spark.createDataFrame(spans, "file_path string, span_id string, start long, end long")).collect()}
    want = {}
    for key, i, at in points:
        around = [(s, name) for k, name, s, e in spans if key is not None and k == key and at is not None and s <= at < e]
        if around:
            want[i] = max(around)[1]
    assert got == want


def test_innermost_scope_keeps_calls_without_one(spark):
    calls = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 1)], "call_id int, file_path string, position int")
    scopes = spark.createDataFrame([("f", "outer", 0, 20), ("f", "inner", 4, 6)], "file_path string, scope_id string, start_byte int, end_byte int")
    assert {r.call_id: r.scope_id for r in R.innermost_scope(calls, scopes).collect()} == {1: "inner", 2: None, 3: None}


def test_one_large_file(spark):
    """A hundred thousand calls in ten thousand scopes of one file: a join of the two would be a billion pairs."""
    calls = spark.range(100_000).select(F.lit("f").alias("file_path"), F.col("id").alias("point_id"), (F.col("id") * 10 + 5).alias("position"))
    scopes = spark.range(10_000).select(F.lit("f").alias("file_path"), F.col("id").alias("span_id"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 60).alias("end"))
    scopes = scopes.union(scopes.limit(1).select("file_path", F.lit(10_000).cast("long"), F.lit(-1).cast("long"), F.lit(10_000_000).cast("long")))
    began = time.perf_counter()
    found = intervals.innermost(calls, scopes).where("span_id < 10000")
    assert found.count() == 60_000 and found.where("point_id div 10 <> span_id").count() == 0
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("cell", [4096, 5])
def test_contained(spark, cell):
    rnd = random.Random(cell)
    rows = [(i, rnd.choice("ab"), (a := rnd.randrange(40)), a + rnd.randrange(0, 25), rnd.randrange(3)) for i in range(300)] + [(900, "a", 9, 3, 0), (901, None, 1, 2, 0)]
    got = {r.id: r.inside for r in intervals.contained(spark.createDataFrame(rows[:-1], "id int, key string, start int, end int, rank int"), ["key"], 3, cell).collect()}
    assert got == {i: any(k == key and r >= rank and s <= start and end <= e and (s < start or end < e) and e >= s for _, k, s, e, r in rows) for i, key, start, end, rank in rows[:-1]}
