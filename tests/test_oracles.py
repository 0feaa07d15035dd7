"""Every registered query on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, database, name):
    verdict, rows, _ = compare(spark, database, name, FOLDER)
    assert rows > 0
    assert verdict.startswith("equal") or verdict == "rows only", verdict
