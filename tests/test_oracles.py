"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import quire.plans as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rounded(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    expected = duck.sql(plans.oracles()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(rounded, r)) for r in df.collect())
    assert got and got == sorted(tuple(rounded(r[i]) for i in order) for r in expected.fetchall())
