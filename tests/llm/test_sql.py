"""Registered SQL of the training-data operators on the smallest tables."""

import duckdb
import pytest

from inkwell.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
