"""Driver contract: entry() runs on sf0.001 and every registered query
matches its DuckDB oracle there (row count, columns, values)."""

import datetime as dt
import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from shopfloor.sources.tables import TEST_TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "30 Days Quantity" in df.columns


def test_every_report_query_has_an_oracle():
    """Only training-text operators may be beyond SQL; their own tests check
    those."""
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(E.queries()) - set(E.oracle_sql()))


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TEST_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    order = sorted(sdf.columns)
    s_idx = [sdf.columns.index(c) for c in order]
    o_idx = [ocols.index(c) for c in order]
    srows = sorted((tuple(_norm(r[i]) for i in s_idx) for r in sdf.collect()), key=repr)
    orows = sorted((tuple(_norm(r[i]) for i in o_idx) for r in res.fetchall()), key=repr)
    assert len(srows) == len(orows)
    assert srows == orows
