"""Physical-plan properties the design relies on (checked on the planned query, not the results)."""

from __future__ import annotations

import pytest

import __spark_entry__ as ep
from ledgerlake.plans import registry

registry.load_all()
QUERIES = {k: v for k, v in ep.queries().items() if k in registry.QUERIES}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def _plan(spark, small_dir, name: str) -> str:
    df = QUERIES[name](spark, small_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_at_a_time_python(spark, small_dir, name):
    plan = _plan(spark, small_dir, name)
    assert not [f for f in FORBIDDEN if f in plan], name


def test_period_filter_and_columns_reach_the_scan(spark, small_dir):
    df = QUERIES["a1_spending_by_category"](spark, small_dir)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate" in text
    assert "o_orderstatus" not in text.split("ReadSchema: struct<o_orderkey")[1].split(">")[0]


def test_transactions_are_combined_before_the_shuffle(spark, small_dir):
    plan = _plan(spark, small_dir, "a1_spending_by_category")
    assert "partial_sum" in plan


@pytest.mark.parametrize("name", ["a5_top_merchants", "t4_recent_transactions", "t5_top_categories", "w5_top_per",
                                  "t1_recent_history"])
def test_per_key_top_k_is_limited_before_the_shuffle(spark, small_dir, name):
    assert "WindowGroupLimit" in _plan(spark, small_dir, name)


def test_widget_work_is_dealt_to_all_tasks(spark, small_dir):
    import __spark_entry__ as ep
    from ledgerlake.operators import refresh as R
    from ledgerlake.sources import fixtures as X
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and ep.queries()["f6_set_widget_data"](spark, small_dir).rdd.getNumPartitions() == n
    asked = R.requests(X.widget_queries(spark, small_dir))
    assert asked.rdd.getNumPartitions() == n and not asked.schema["set_id"].nullable
