"""Every query that has SQL gives the same rows as DuckDB; the others run and have rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wavecrest.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["series_id", "code", "prediction"] and out.count() == 100


def test_interpolated_ties(spark, tmp_path):
    """Short series with equal values on both sides of the middle: the interpolated values next to it tie, and only their last bits tell them apart."""
    rng, rows = np.random.RandomState(5), []
    for user in range(300):
        x = rng.exponential(50, 45 + 2 * rng.randint(10)).round(2)
        x[len(x) // 2 + 1] = x[len(x) // 2 - 1]
        rows += [(len(rows) + i, user, float(v)) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    # in one thread the SQL adds the values in their order
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("fam_turning_users", "fam_perm_entropy_users"):
        got = QUERIES[name](spark, str(tmp_path)).select("series_id", "w", "col", "val").collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT series_id, w, col, val FROM ({ORACLE[name]})").fetchall())


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
