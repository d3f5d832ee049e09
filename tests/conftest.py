import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    local = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", local)
        .config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/sf0.01"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/sf0.01/{name}'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def rows_of(frame) -> list[str]:
    """Rows as sorted strings, columns by name; floats to nine digits."""
    frame = frame[sorted(frame.columns)]

    def show(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(show, v)) + "]"
        return str(v)

    return sorted(" | ".join(show(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a registered query with its SQL."""

    def check(name: str, queries: dict, sql: dict) -> None:
        got = queries[name](spark, sf).toPandas()
        want = duck.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        assert rows_of(got) == rows_of(want)

    return check
