"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from conftest import SF  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
EMPTY = {"tail_per_key"}  # no series is long enough at this size
LONG = {"ml_boost"}  # a hundred rounds; see test_models


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(set(ORACLES) - LONG))
def test_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    res = con.execute(ORACLES[key])
    names = [d[0] for d in res.description]
    theirs = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    mine = [tuple(r) for r in df.collect()]
    assert check.rows_of(df.columns, mine) == check.rows_of(names, theirs)
    assert mine or key in EMPTY


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_gives_rows(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["ticker", "bar_ts"] and df.count() > 0
