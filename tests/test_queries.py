"""Every registered query against its SQL on the smallest tables, and its plan."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return compare.oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql_without_nested_loops(spark, db, name):
    assert compare.compare(spark, db, FOLDER, QUERIES[name], SQL.get(name)) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 3
