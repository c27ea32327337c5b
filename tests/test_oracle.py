"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cadenza.plans import queries as own

QUERIES, SQL = own.queries(), own.oracle_sql()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf, db, name):
    frame = QUERIES[name](spark, sf)
    want = db.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in frame.columns]
    got = sorted(tuple(map(norm, r)) for r in frame.collect())
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall()) and got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
