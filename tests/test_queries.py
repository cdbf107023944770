"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quarry.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no generated tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.4f}" if abs(v) < 1e6 else f"{float(v):.7g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted([plain(r[k]) for k in at] for r in found.fetchall())


def test_hints_of_all_users(spark, duck):
    got = {r.user_id for r in QUERIES["type_hint_whole"](spark, str(DATA)).collect()}
    assert got == {u for (u,) in duck.sql("SELECT DISTINCT user_id FROM events").fetchall()}


def test_joins_of_whole_tables(spark, duck):
    rows = QUERIES["join_full_whole"](spark, str(DATA)).collect()
    assert {r.c_custkey for r in rows} - {None} == {k for (k,) in duck.sql("SELECT c_custkey FROM customer").fetchall()}
    assert {r.o_orderkey for r in rows} - {None} == {k for (k,) in duck.sql("SELECT o_orderkey FROM orders").fetchall()}
    assert any(r.c_custkey is None for r in rows)
