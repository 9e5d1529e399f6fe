"""Small-world graphs against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as Q
from millrace.operators import small_world as S


@pytest.mark.parametrize("clusters", [0, 12])
def test_graph(clusters):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1500, 24))
    if clusters:  # tight groups far from each other
        x = 0.1 * x + 3 * rnd.normal(size=(clusters, 24))[rnd.integers(0, clusters, 1500)]
    x = S.unit(x)
    graph = S.Graph.build(x)
    assert all(len(own[0]) <= 2 * S.M and all(len(up) <= S.M for up in own[1:]) for own in graph.links)
    asked = S.unit(x[::10] + 0.01 * rnd.normal(size=(150, 24)))
    hits = sum(len(set(graph.search(q, 10)) & set(np.argsort(-(x @ q))[:10].tolist())) for q in asked)
    assert hits >= 0.95 * 1500
    assert S.Graph.build(x[:0]).search(x[0], 3) == [] and S.Graph.build(x[:1]).search(x[0], 3) == [0]
    assert sorted(S.Graph.build(np.repeat(x[:1], 60, axis=0)).search(x[0], 60))[:3] == [0, 1, 2]


def test_index(spark):
    rnd = np.random.default_rng(6)
    rows = [(f"v{i}", rnd.normal(size=16).tolist()) for i in range(900)] + [("none", None), ("zero", [0.0] * 16), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id string, vector array<float>")
    index = S.build_index(vectors, shard_rows=200)
    assert index.select("shard").distinct().count() == 5 and index.count() == 902
    asked = vectors.where("id in ('v0', 'v17', 'v200', 'short', 'none', 'zero')").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    more = spark.createDataFrame([(f"q{i}", rnd.normal(size=16).tolist()) for i in range(40)], "query_id string, query_vector array<float>")
    got = S.search_index(index, asked.union(more), 5).collect()
    exact = {(r.query_id, r.id): r.score for r in Q.vector_batch_top(vectors.where("size(vector) = 16"), asked.where("size(query_vector) = 16").union(more), 5).collect()}
    near = [r for r in got if r.query_id not in ("short", "zero")]
    assert len(near) == 5 * 43 and sum((r.query_id, r.id) in exact for r in near) >= 0.95 * len(near)
    assert all(abs(r.score - exact[r.query_id, r.id]) < 1e-9 for r in near if (r.query_id, r.id) in exact)
    assert [(r.id, r.rank) for r in got if r.query_id == "short"] == [("short", 1)] and {r.score for r in got if r.query_id == "zero"} == {0.0}
    both = index.union(S.build_index(vectors.where("id < 'v3'"), shard_rows=200, first_shard=50))
    assert both.select("shard").distinct().count() > 5
    assert S.search_index(index, asked.limit(0), 5).count() == 0 and S.search_index(index.limit(0), asked, 5).count() == 0


def test_copies(spark):
    """Of many equal vectors an answer has those with the smallest ids, as the exact search does."""
    rnd = np.random.default_rng(8)
    own = rnd.normal(size=(40, 16)).tolist()
    vectors = spark.createDataFrame([(i, own[i % 40]) for i in range(1600)], "id long, vector array<float>")
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = S.build_index(vectors, shard_rows=500)
    assert index.count() == 1600 and index.where("layer >= 0").count() <= 40 * index.select("shard").distinct().count()
    pick = lambda found: sorted((r.query_id, r["rank"], r.id) for r in found.collect())
    assert pick(S.search_index(index, asked, 50)) == pick(Q.vector_batch_top(vectors, asked, 50))


def test_search_as_wide_as_its_shard_needs(spark):
    """Vectors of many dimensions without groups: a search of EF_SEARCH candidates finds less than 0.9 of the nearest."""
    rnd = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, rnd.normal(size=128).tolist()) for i in range(2200)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, rnd.normal(size=128).tolist()) for i in range(60)], "query_id long, query_vector array<double>")
    index = S.build_index(vectors)
    assert index.select("breadth").distinct().count() == 1 and index.first().breadth > S.EF_SEARCH
    pick = lambda found: {(r.query_id, r.id) for r in found.collect()}
    assert len(pick(S.search_index(index, asked, 10)) & pick(Q.vector_batch_top(vectors, asked, 10))) >= 0.9 * 600
