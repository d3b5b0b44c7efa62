"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pytest

from kinfold.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    return "nan" if isinstance(x, float) and x != x else round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in rows)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
