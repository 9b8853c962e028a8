"""Every registered data-quality query with SQL against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from plumbline.plans.queries import ORACLES, QUERIES
from plumbline.sources.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        if x is None or x != x:
            return "NULL"
        return str(round(float(x), 6)) if isinstance(x, float | decimal.Decimal) else str(x)

    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).collect()[0]["check_id"] == "TMP-SHIP"
    assert set(e.oracle_sql()) <= set(e.queries())
