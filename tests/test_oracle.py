"""Every registered relational query against its SQL twin, on the smallest given tables."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from sunledger.catalog.queries import QUERIES

TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert difference(got, duck.execute(TWINS[name]).df()) is None
    assert len(got)


def test_every_relational_query_has_a_twin():
    assert set(QUERIES) <= set(TWINS)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
