"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tagloom.plans.queries import QUERIES
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Nothing of the tiny tables falls under these rules.
MAY_BE_EMPTY = ()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, SF_DIR)
    assert problem is None or (problem == "both empty" and name in MAY_BE_EMPTY)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
