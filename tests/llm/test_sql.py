"""The operators that SQL can express, against their SQL on a second engine."""

import duckdb
import pytest

from logsift.llm import queries

ORACLES = queries.all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    found = queries.all_queries()[name](spark, small)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == want
