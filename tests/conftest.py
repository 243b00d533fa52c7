import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def same_rows(df, result):
    """A DataFrame's rows against a DuckDB result's, in any order, columns by name."""
    assert sorted(df.columns) == sorted(result.columns)
    names, at = sorted(df.columns), {c: i for i, c in enumerate(result.columns)}
    ours = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(normal(r[at[c]]) for c in names) for r in result.fetchall()), key=repr)
    assert ours == theirs
