import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """Runs a query over the shared test tables and its SQL in DuckDB, as sorted rows of text."""
    import duckdb

    def run(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
        frame = query(spark, sf_dir)
        names = sorted(frame.columns)
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        pick = lambda rows, columns: sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in rows)
        return pick(frame.collect(), frame.columns), pick(rel.fetchall(), rel.columns)

    def plain(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, list | tuple):
            return str([plain(x) for x in v])
        return str(v)

    return run
