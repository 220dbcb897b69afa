"""Registered queries against their SQL, and the shape of their plans."""

from __future__ import annotations

import os
import re

import pytest

from tests.check_oracle import compare, connect
from tidemark.plans import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def check_plan(plan: str) -> None:
    """No Python in the plan, no cross product, and no window over a whole table."""
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan
    for spec in re.findall(r"windowspecdefinition\((.*?)\)", plan):
        assert not re.match(r"\S+ (ASC|DESC)", spec), f"window without partition: {spec}"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql_and_plan_is_distributed(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ("batch_scoring", "group_regression"):  # these call a user's Python functions
        check_plan(plan_of(df))
    assert compare(df.toPandas(), duck.execute(ORACLE[name]).df()) is None


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["daily_extract"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_orderpriority" not in re.search(r"ReadSchema: (.*)", plan)[1]
    plan = plan_of(QUERIES["approval_lookup"](spark, FOLDER))
    assert "EqualTo(o_custkey,77)" in plan
    plan = plan_of(QUERIES["rider_features_daily"](spark, FOLDER))
    schema = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "props" not in schema and "event_type" not in schema


def test_trailing_windows_share_one_pass(spark):
    plan = plan_of(QUERIES["driver_features_daily"](spark, FOLDER))
    # One shuffle folds equal instants, one brings keys together for all windows.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("+- Window") == 2
