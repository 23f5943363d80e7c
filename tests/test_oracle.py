"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_point
from oracle import connect, difference

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_answer(name, spark, sf, con):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
