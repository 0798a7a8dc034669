"""Every registered query against its twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from compare import TABLES, compare
from conftest import SMALL

import __spark_entry__ as entry

RUN, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(RUN)


@pytest.mark.parametrize("name", list(RUN))
def test_query(spark, duck, name):
    got = RUN[name](spark, SMALL).toArrow()
    if name in TWINS:
        assert compare(got, duck.execute(TWINS[name]).to_arrow_table()) == ""
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
