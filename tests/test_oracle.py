import os

import duckdb
import pytest

import __spark_entry__ as entry
from pipewright.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, con, name):
    got, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    mine = sorted((tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert mine == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 or len(rows) == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
