"""Every registered query beside its SQL, and the shape of its plan."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as spark_entry
from carelattice.plans.registry import QUERIES, SQL
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

# Too few rows at this size for a hit.
MAY_BE_EMPTY = {"retry_pairs", "near_values", "phi_scan", "minimum_necessary"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    found = differences(df, connection, SQL[name])
    if name in MAY_BE_EMPTY:
        found = [f for f in found if f != "no rows at all"]
    assert found == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
