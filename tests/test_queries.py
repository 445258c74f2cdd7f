"""Every analytic query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from meterlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def test_every_query_has_sql():
    assert sorted(SQL) == sorted(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
