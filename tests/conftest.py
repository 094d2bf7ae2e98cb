import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
    session = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    """Rows as sorted text, for comparison."""

    def show(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(show(r[i]) for i in order) for r in rows)


def same_as_sql(df, duck, sql):
    got, want = df.collect(), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)

    def number(v):
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    fix = lambda rows: [[number(v) for v in r] for r in rows]
    assert plain(fix(got), df.columns) == plain(fix(want.fetchall()), want.columns)
