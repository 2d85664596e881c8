"""Every registered query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from lakeline.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not there")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def cell(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted(tuple(cell(r[i]) for i in order) for r in records)
    return [columns[i] for i in order], body


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, oracle, name):
    found = contract.queries()[name](spark, SF_DIR)
    expected = oracle.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert table(found.columns, found.collect()) == table(columns, expected.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["title_counts_skip", "title_counts_file"])
def test_keeping_the_rule_line_would_show(oracle, name):
    kept = oracle.execute(contract.oracle_sql()["title_counts"]).fetchall()
    assert sorted(kept) != sorted(oracle.execute(contract.oracle_sql()[name]).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
