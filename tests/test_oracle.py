"""Every registered query with SQL against that SQL on the smallest tables."""

import pytest

from tests.compare import assert_same, connection
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE[name])
