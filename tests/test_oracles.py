"""Every registered query against its oracle on the smallest data."""

import os

import oracle
import pytest

from rasterloom.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    oracle.compare(con, QUERIES[key](spark, SF_DIR), ORACLES[key])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["zone", "yr", "pixels", "km2"]
    assert entry.queries().keys() >= QUERIES.keys()
