"""The registered SQL against the queries, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from weftlink.llm.queries import llm_queries
from weftlink.llm.sql import BY_QUERY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(BY_QUERY))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.execute(BY_QUERY[name]), llm_queries()[name](spark, SF)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
