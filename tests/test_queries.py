"""Every registered query against the same question in plain SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file[:-8]} as select * from '{SF_DIR}/{file}'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    cursor = duck.execute(ORACLES[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    expected = [tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert got, "the given tables should exercise every query"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
