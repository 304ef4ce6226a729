"""Registered queries against their SQL twins in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.01"
CHOSEN = ["flagship", "W1_sliced", "W5_sliced", "W7_sliced", "W9_sliced", "A3_bracketed", "A8_pairs", "A9", "A16", "C4", "H7", "J2", "M16", "N3", "Q9", "X4", "P8"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", CHOSEN)
def test_query_equals_sql(spark, con, key):
    got = entry.queries()[key](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[key]).df()
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
