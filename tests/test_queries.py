"""Registered queries against their SQL twins at the smallest scale."""

import pytest

from lodestone.registry import ORACLE, QUERIES
import lodestone.queries  # noqa: F401
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    problem, rows = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE.get(name))
    assert problem == "" and rows >= 0
