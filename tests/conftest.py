import os
import sys
import tempfile

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    d = tempfile.mkdtemp(prefix="/tmp/spark-")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
            "spark.checkpoint.dir": f"{d}/shared", "spark.local.dir": d, "spark.sql.warehouse.dir": f"{d}/warehouse"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(df, con, sql):
    """Equal column names and, whatever the order, equal rows (floats to 9 digits)."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=key)
    want = sorted((tuple(cell(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()), key=key)
    assert got == want
