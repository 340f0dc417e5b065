"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry_point
from parterre.plans.oracle import ORACLE
from parterre.plans.queries import QUERIES
from tests.oracle_check import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    found = entry_point.queries()[name](spark, FOLDER)
    assert difference(found, con, entry_point.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1000
