import os
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _cell(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture
def same_rows():
    """Whether a Spark result and DuckDB SQL over the tables of a folder have the same columns and rows."""
    import duckdb

    def check(df, sql: str, folder: str):
        con = duckdb.connect()
        for name in os.listdir(folder):
            place = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{place}'")
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        order = sorted(names)
        assert order == sorted(df.columns)
        there = Counter(tuple(_cell(r[names.index(c)]) for c in order) for r in cur.fetchall())
        here = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
        assert here == there

    return check
