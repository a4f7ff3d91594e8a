"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks import oracle, queries as catalog
from checks.compare import connect, differences

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables(folder):
    return connect(folder)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, folder, tables, name):
    found = differences(QUERIES[name](spark, folder), tables.execute(SQL[name]).df())
    assert not found, "\n".join(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
