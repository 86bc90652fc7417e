"""Every query of the library against its SQL on another engine, over the smallest tables."""

import datetime

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert registry.flagship(spark, SF).count() > 0
