"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from veilstat import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted([tuple(round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in (r[i] for i in at)) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(want.fetchall(), want.columns, order)


def test_flagship(spark):
    assert queries.flagship(spark, DATA).count() == 1


def test_mean_bootstrap_is_near_the_mean(spark):
    mean = spark.read.parquet(f"{DATA}/part.parquet").selectExpr("avg(p_size)").first()[0]
    assert all(abs(r.release - mean) < 8 for r in queries.mean_bootstrap(spark, DATA).collect())
