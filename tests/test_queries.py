"""Every registered query of the library itself against its SQL in DuckDB, and plans against partitioning."""

from __future__ import annotations

import os

import pytest

from framewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row) -> tuple:
    return tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    assert sorted(duck.sql(catalog.SQL[name]).columns) == columns
    want = sorted(plain(r) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
