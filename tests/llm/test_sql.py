"""Queries that SQL can express, against DuckDB over the whole small tables."""

import pytest

from tests.oracle import compare, duck
from vigilo.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(QUERIES[name](spark, SF), SQL[name], con)
    assert ok, message


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
