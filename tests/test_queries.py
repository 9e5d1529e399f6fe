"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from millrace import queries as core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    got, want = data(spark, core.queries()[name], core.oracle_sql()[name])
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == core.FLAGSHIP_K and set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_html_markdown(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as T

    html = "<html><style>p{}</style><h2>Big &amp; bold</h2><p>See <a href='http://x.org'>this</a></p><ul><li>one</li><li>two</li></ul><script>x()</script>a<br>b</html>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(T.html_to_markdown(F.col("h")).alias("m")).collect()
    assert got[0].m == "## Big & bold\nSee [this](http://x.org)\n\n- one\n- twoa\nb" and got[1].m == ""
