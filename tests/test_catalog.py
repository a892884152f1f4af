"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidemill.plans import catalog, file_catalog

SQL = catalog.ORACLE_SQL | file_catalog.ORACLE_SQL
QUERIES = catalog.QUERIES | file_catalog.QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def ordered(columns, rows):
    """Rows by sorted column names, sorted by everything but their rounded numbers."""
    names = sorted(columns)
    at = [list(columns).index(c) for c in names]
    return names, sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: [str(x) for c, x in zip(names, r, strict=True) if c not in ROUNDED])


ROUNDED = {"avg_price"}


def same(column, a, b):
    """Equal, but for the last digit of a rounded average on an exact half."""
    return a == b or column in ROUNDED and abs(a - b) < 0.011


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    found = __spark_entry__.queries()[name](spark, SMALL)
    columns, rows = ordered(found.columns, found.collect())
    asked = db.execute(SQL[name])
    want_columns, want = ordered([c[0] for c in asked.description], asked.fetchall())
    assert columns == want_columns and len(rows) == len(want)
    assert all(same(c, a, b) for r, w in zip(rows, want, strict=True) for c, a, b in zip(columns, r, w, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) == set(QUERIES)
