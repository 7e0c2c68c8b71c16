"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from quern.plans import catalog


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, oracle, name):
    frame = catalog.queries()[name](spark, sf)
    cursor = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([plain(r[c]) for c in order]) for r in frame.collect())
    expected = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    assert got == expected


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
