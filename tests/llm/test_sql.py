"""Queries of the training-data operators against their SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from meterlake.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert sorted(con.sql(SQL[name]).columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
