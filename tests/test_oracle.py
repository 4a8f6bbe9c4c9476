"""Every registered query against its DuckDB oracle (sf0.001 by default)."""

import os

import pytest

from vigilo.plans.catalog import REGISTRY
from tests.oracle import compare, duck

SF = os.environ.get("VIGILO_TEST_SF", "/root/testdata/sf0.001")
WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(REGISTRY[name].fn(spark, SF), REGISTRY[name].sql, con)
    assert ok, msg
