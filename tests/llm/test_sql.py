"""The text queries with SQL give what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from scoutlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.SQL[name])
    at = [want.columns.index(x) for x in df.columns]
    assert len(want.columns) == len(at)
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
