"""Every query with SQL equals DuckDB on the small data set; fitted models are tested in test_models."""

import pytest

import compare
import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    problem, _count = compare.difference(entry.queries()[name](spark, sf), con, ORACLES[name])
    assert problem is None, f"{name}: {problem}"


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
