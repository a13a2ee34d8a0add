"""Every registered query against DuckDB on the small tables."""

import os

import pytest

from check import compare, connect
from evidentia.plans.catalog import registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, _, problem = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert problem is None
    assert rows > 0
