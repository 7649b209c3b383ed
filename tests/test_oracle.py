"""Every registered query against its SQL twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from eventloom.plans import catalog, check  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, message, _ = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
