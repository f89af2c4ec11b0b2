"""Every registered query against its SQL twin on the smallest test data."""

import duckdb
import pytest

from check import TABLES, compare
from runlens.plans import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, db, name):
    ok, text = compare(spark, db, FOLDER, name, all_queries()[name], all_oracles().get(name))
    assert ok, text


def test_oracles_have_queries():
    assert set(all_oracles()) <= set(all_queries())
