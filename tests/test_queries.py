"""Every registered query against its SQL on the smallest tables, without cross joins."""

import pytest

import __spark_entry__ as contract
from gridmat.plans.table_queries import ORACLES, QUERIES
from oracle import TESTDATA, compare, open_tables

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["i", "j", "v"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df, con, contract.oracle_sql()[name]) is None
