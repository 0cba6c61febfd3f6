"""Every registered query next to its SQL counterpart on the smallest scale."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as driver

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not there")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, tables, name):
    df = driver.queries()[name](spark, SF_DIR)
    oracle = driver.oracle_sql().get(name)
    if oracle is None:
        assert df.columns and df.collect()
    else:
        assert compare(df, tables.sql(oracle)) == []


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns and df.count() > 0


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())
