"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import compare
from ledgerlane.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
SQL = entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) <= set(SQL)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_oracle(spark, con, name):
    verdict = compare.compare(spark, con, name, entry.queries()[name], SQL[name], SF_DIR)
    assert verdict.startswith("ok"), verdict
