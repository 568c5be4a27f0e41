"""Every registered query against its SQL on the smallest tables."""
import inspect
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["date", "account_code", "account_name"]


def test_registry_needs_no_session():
    assert len(inspect.signature(entry.queries).parameters) == 0 and len(QUERIES) > 100
