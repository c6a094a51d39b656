import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same_rows(got, want) -> bool:
    """Whether two lists of rows are the same bags, floats to nine digits."""

    def plain(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def against_sql(spark, name: str, queries: dict, sql: dict, sf: str = "sf0.001") -> None:
    import duckdb

    c = duckdb.connect()
    for f in (DATA / sf).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries[name](spark, str(DATA / sf))
    cols = sorted(df.columns)
    got = [tuple(r[x] for x in cols) for r in df.collect()]
    q = c.execute(sql[name])
    have = [x[0] for x in q.description]
    assert sorted(have) == cols
    want = [tuple(r[have.index(x)] for x in cols) for r in q.fetchall()]
    assert same_rows(got, want)
