import pytest

from tests.oracle import compare
from tidemark.plans import reviews, studies  # noqa: F401  register further queries
from tidemark.plans.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_duckdb(spark, name):
    compare(spark, SMALL, QUERIES[name], SQL[name])
