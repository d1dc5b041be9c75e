"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from emberlog.plans.queries import QUERIES
from tests.conftest import plan_text
from tests.oracle_check import connect, oracle_rows, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    found = rows_of(df)
    plan = plan_text(df)
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan
    assert found == oracle_rows(con, name)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["start", "group", "count"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
