"""Every query with SQL equals that SQL in an independent engine, and none is empty."""

import os

import duckdb
import pytest

from tidewell.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    spark.catalog.clearCache()
    assert got
    if name in ORACLE_SQL:
        res = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())
