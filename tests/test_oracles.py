"""Every registered query with SQL against DuckDB, at the smallest scale; the corpus operators have tests of their own."""

import pytest

from oracle import compare, connect
from querymill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, con, name):
    compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
