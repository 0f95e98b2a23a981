"""What the physical plans must look like: pruned and filtered scans, no Python where none is needed."""

import re

import pytest

import __spark_entry__
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return __spark_entry__.queries()


@pytest.mark.parametrize("name", ["a1_edges", "a4_edges_by_type", "a16_namespace_coupling", "a21_type_rollup", "a24_hierarchy", "w3_top_complexity", "a31_diagnostics_per_project", "f8_maintainability"])
def test_analytics_stay_in_the_engine(spark, queries, name):
    plan = plan_of(queries[name](spark, SMALL))
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, queries):
    plan = plan_of(queries["a4_edges_by_type"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(dep_type,2\)", plan)
    assert all(c not in plan for c in ("source_location", "referenced_symbol", "recorded_at"))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_top_lists_are_limited_before_the_sort_of_all(spark, queries):
    assert "WindowGroupLimit" in plan_of(queries["w3_top_complexity"](spark, SMALL))


def test_dense_totals_read_two_columns_and_shuffle_once(spark, queries):
    plan = plan_of(queries["p4_totals"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<from_entity:string,reference_count:int>", plan) and plan.count("Exchange") == 1


def test_nested_records_need_no_shuffle(spark, queries):
    plan = plan_of(queries["p1_found"](spark, SMALL))
    assert "Exchange" not in plan and "received_at" not in plan


def test_every_query_is_registered_once_and_callable(queries):
    sql = __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values()) and len(queries) > 70
