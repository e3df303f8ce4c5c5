"""Every engine query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

from marlstone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def ordered(rows, columns):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in by_name) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want.fetchall(), want.columns)
