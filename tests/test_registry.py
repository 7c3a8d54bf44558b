"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from scoutlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.collect()]
    if name not in registry.SQL:
        return
    want = duck.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
