"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
# Whole grids of tree candidates on every fold; run by the benchmark and the driver.
SLOW = {"tree_cv", "tree_forecast"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert differences(spark, connection, QUERIES[name], ORACLES[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark, sf_dir):
    df = entry(spark)
    assert {"series", "date", "n_orders_lag_12"} <= set(df.columns) and not df.isEmpty()
