"""Every query with an oracle gives the rows of its SQL, on whole tables."""

import os
import sys

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, compare


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_as_sql(spark, con, name):
    result, _, _ = compare(spark, con, SMALL, name)
    assert result.startswith(("same", "rows only")), result
    assert "TYPES" not in result, result


def test_entry(spark):
    assert entry.entry(spark).count() == 1
