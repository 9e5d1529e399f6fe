"""Blocks of postings give what scoring all documents gives."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranked
from millrace.operators import retrieval as Q


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice((1, 3, 8, 40, 200))))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "W1 w1 only"), (2003, "w1 w1 only")]
    return spark.createDataFrame(rows, "id int, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    root = tmp_path_factory.mktemp("ranked")
    out = {}
    for name, rows in ranked.build(corpus, bucket_docs=20).items():
        rows.write.parquet(f"file://{root}/{name}")
        out[name] = spark.read.parquet(f"file://{root}/{name}")
    return out


@pytest.mark.parametrize("query, k", [("w1", 10), ("w7 w9 w30", 5), ("w1 w1 w2 w50", 20), ("only", 10), ("w3 missing", 3), ("missing", 3), ("", 3), ("w1 w2", 5000)])
def test_ranked(corpus, index, query, k):
    found, read = ranked.search(index["blocks"], index["terms"], query, k)
    want = Q.top(Q.bm25(corpus, query), k).collect()
    got = found.collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want]
    terms = [t for t in set(query.split())]
    there = corpus.select("id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " "))).alias("t")).where(F.col("t").isin(*(terms or [""])) & (F.col("t") != "")).count()
    assert read.there == there and read.read <= there


def test_a_rare_good_answer_spares_reading(corpus, index):
    _, read = ranked.search(index["blocks"], index["terms"], "only w7", 2)
    assert 0 < read.read < 0.3 * read.there
    assert {r.df for r in index["terms"].where("term = 'only'").collect()} == {2}


def test_many_buckets(corpus, index, monkeypatch):
    """More buckets than a filter names are joined."""
    monkeypatch.setattr(ranked, "NAMED_BUCKETS", 3)
    found, _ = ranked.search(index["blocks"], index["terms"], "w1 w2", 300)
    assert [r.id for r in found.collect()] == [r.id for r in Q.top(Q.bm25(corpus, "w1 w2"), 300).collect()]
