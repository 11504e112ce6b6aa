"""Every catalogue query beside its SQL in DuckDB, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

CHECKED = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    assert compare(queries()[name](spark, sf), duck, oracle_sql()[name]) == ""


def test_entry_has_twenty_features(spark):
    assert entry(spark).count() == 20
