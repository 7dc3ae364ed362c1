"""Every registered query against its SQL twin on the smallest data, and the contract."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["tl_id", "part", "text"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, message = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()
