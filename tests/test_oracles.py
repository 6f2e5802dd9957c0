"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.oracle import DATA, difference, duck

SF = "sf0.001"
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("p7_", "p8_", "p9_"))}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(__spark_entry__.queries()[name](spark, f"{DATA}/{SF}"), con, SQL[name]) == ""


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
