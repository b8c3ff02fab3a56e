"""Widgets with filters and goals: the one-pass refresh against a query per widget."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import goals as G
from ledgerlake.operators import refresh as R
from ledgerlake.operators import widgets as W
from ledgerlake.sources import fixtures as X

AS_OF = datetime(2024, 8, 31, 15, 30)
ACC = "account_id bigint, user_id bigint, account_type string, balance decimal(15,2), name string"
TX = "id bigint, from_account_id bigint, to_account_id bigint, amount decimal(15,2), type string, description string, category string, status string, created_at timestamp_ntz"


def refreshed(spark, configs, acc, tx, mode="dynamic"):
    rows = [(i, user, mode, json.dumps(c) if isinstance(c, dict) else c, '{"customProps":{"height":1}}') for i, (user, c) in enumerate(configs)]
    w = spark.createDataFrame(rows, "widget_id bigint, user_id bigint, data_mode string, query_config string, config string")
    out = {r["widget_id"]: r for r in R.refresh_widgets(w, tx, acc, AS_OF).collect()}
    assert set(out) == set(range(len(configs)))
    return out


def data(row):
    config = json.loads(row["config"])["customProps"]
    assert config["height"] == 1
    return config.get("data")


@pytest.fixture(scope="module")
def bank(spark):
    acc = spark.createDataFrame([(1, 10, "checking", Decimal("100.00"), "Main"), (2, 10, "savings", Decimal("50.50"), "Nest"),
                                 (3, 10, "savings", Decimal("9.50"), "Nest"), (4, 11, "credit", Decimal("-70.00"), "Card")], ACC)
    edge = AS_OF - timedelta(days=30)                  # 2024-08-01 15:30
    rows = [(1, 1, None, "5.00", "payment", "shop", "Food", edge), (2, 1, None, "7.00", "payment", "shop", "Food", edge - timedelta(seconds=1)),
            (3, 2, None, "3.25", "payment", "", None, AS_OF), (4, 1, None, "2.00", "payment", None, "", AS_OF - timedelta(days=1)),
            (5, None, 2, "40.00", "deposit", "pay", "Salary", AS_OF), (6, 1, 2, "11.00", "transfer", "move", None, edge),
            (7, 1, 2, "99.00", "transfer", "move", None, edge - timedelta(seconds=1)), (8, 4, None, "80.00", "payment", "air", "Travel", AS_OF),
            (9, 1, None, "1.00", "payment", "later", "Food", AS_OF + timedelta(seconds=1)), (10, 1, None, "6.00", "payment", "old", "Rent", datetime(2024, 3, 1))]
    tx = spark.createDataFrame([(i, f, t, Decimal(a), k, d, c, "completed", at) for i, f, t, a, k, d, c, at in rows], TX)
    return acc, tx


def test_filters_and_period_edges(spark, bank):
    acc, tx = bank
    month = {"time_range": "last_30_days"}
    out = refreshed(spark, [
        (10, {**month}),                                                                             # no query type
        (10, {**month, "query_type": "spending_by_category", "filters": {"account_id": 2}}),
        (10, {**month, "query_type": "spending_by_category", "filters": {"categories": ["Food", "Travel"], "account_id": 0}}),
        (10, {**month, "query_type": "spending_by_category", "filters": {"account_id": 4}}),           # another user's account
        (10, {**month, "query_type": "top_merchants", "filters": {"limit": 1, "categories": ["Rent"]}}),
        (10, {"query_type": "monthly_income_expenses", "time_range": "last_30_days", "filters": None}),
        (10, {"query_type": "category_trend", "time_range": "this_month", "filters": {"categories": ["Travel", "Food"]}}),
        (10, {"query_type": "account_balances", "filters": {"account_type": "savings"}}),
        (99, {"query_type": "monthly_trend"}), (10, {"query_type": "custom_sql"}),
        (10, {"query_type": "daily_spending", "time_range": "no such range"})], *bank)
    assert data(out[0]) == [{"name": "Food", "value": 5.0}, {"name": "Uncategorized", "value": 3.25}, {"name": "Uncategorized", "value": 2.0}]
    assert data(out[1]) == [{"name": "Uncategorized", "value": 3.25}]
    assert data(out[2]) == [{"name": "Food", "value": 5.0}]
    assert data(out[3]) == [] and out[3]["n_points"] == 0
    assert data(out[4]) == [{"name": "shop", "value": 5.0, "transactions": 1}]                     # other queries don't look at categories
    assert data(out[5]) == [{"name": "Aug 2024", "income": 40.0, "expenses": 17.25}]                # months are whole
    assert data(out[6]) == [{"name": "Aug 2024", "Travel": 0.0, "Food": 12.0}]
    assert data(out[7]) == [{"name": "Nest", "value": 50.5, "type": "savings"}, {"name": "Nest", "value": 9.5, "type": "savings"}]
    assert data(out[8]) == [] and data(out[9]) == []
    # six months before 31 August is 29 February, 15:30
    assert [p["name"] for p in data(out[10])] == ["2024-03-01", "2024-08-01", "2024-08-30", "2024-08-31"]


def test_goals_as_single_objects(spark, bank):
    out = refreshed(spark, [
        (10, {"query_type": "goal_savings_progress", "filters": {"target_amount": 101, "linked_account_name": "Nest"}}),
        (10, {"query_type": "goal_savings_progress", "filters": {"target_amount": 0}}),
        (10, {"query_type": "goal_savings_progress", "filters": {"target_amount": 10, "linked_account_name": "None such"}}),
        (11, {"query_type": "goal_debt_payoff_progress", "filters": {"original_debt": 280}}),
        (10, {"query_type": "goal_spending_limit", "time_range": "last_30_days", "filters": {"spending_limit": 10}}),
        (10, {"query_type": "goal_spending_limit", "time_range": "last_30_days", "filters": {"spending_limit": 10, "category": "Food"}}),
        (99, {"query_type": "goal_spending_limit", "filters": {"spending_limit": 10}})], *bank)
    assert data(out[0]) == {"current_amount": 50.5, "target_amount": 101.0, "progress_percent": 50.0, "remaining": 50.5,
                            "account_name": "Nest", "recent_contributions": 51.0}
    assert data(out[1])["current_amount"] == 60.0 and data(out[1])["progress_percent"] == 0.0 and data(out[1])["recent_contributions"] == 0.0
    assert data(out[2])["account_name"] == "None such" and data(out[2])["remaining"] == 10.0
    assert data(out[3]) == {"current_debt": 70.0, "original_debt": 280.0, "amount_paid": 210.0, "progress_percent": 75.0, "account_name": "All Credit"}
    assert data(out[4]) == {"current_spending": 10.25, "spending_limit": 10.0, "remaining": 0.0, "progress_percent": 100.0,
                            "category": "All Categories", "is_over_budget": True}
    assert data(out[5])["current_spending"] == 5.0 and data(out[5])["progress_percent"] == 50.0 and data(out[5])["is_over_budget"] is False
    assert data(out[6]) == {"current_spending": 0.0, "spending_limit": 10.0, "remaining": 10.0, "progress_percent": 0.0,
                            "category": "All Categories", "is_over_budget": False}


def test_widgets_that_cannot_be_refreshed(spark, bank):
    for mode, config, status in [("static", {"query_type": "monthly_trend"}, "static"), (None, {"query_type": "monthly_trend"}, "static"),
                                 ("dynamic", None, "no_query"), ("dynamic", "no json", "no_query"), ("dynamic", "[1]", "no_query")]:
        row = refreshed(spark, [(10, config)], *bank, mode=mode)[0]
        assert (row["status"], row["n_points"], data(row)) == (status, None, None)
    assert R.refresh_widgets(X_none(spark), bank[1], bank[0], AS_OF).count() == 0


def X_none(spark):
    return spark.createDataFrame([], "widget_id bigint, user_id bigint, data_mode string, query_config string, config string")


def test_every_widget_equals_its_own_query(spark, small_dir):
    """Each stored chart alone, through the query by name with the filters that it looks at."""
    tx, acc = X.transactions(spark, small_dir), X.accounts(spark, small_dir)
    widgets = X.widget_queries(spark, small_dir).where("data_mode = 'dynamic'").checkpoint()
    out = {r["widget_id"]: r for r in R.refresh_widgets(widgets, tx, acc, X.BANK_AS_OF).collect()}
    looked_at = {"spending_by_category": ["account_id", "categories"], "monthly_trend": ["account_id"], "daily_spending": ["account_id"],
                 "monthly_income_expenses": ["account_id"], "top_merchants": ["account_id", "limit"], "account_balances": ["account_type"]}
    tried = set()
    for r in widgets.where("user_id % 7 = 3").collect():
        config = json.loads(r["query_config"])
        name = config["query_type"]
        if name not in looked_at:
            continue
        filters = {k: config["filters"][k] for k in looked_at[name] if config["filters"].get(k)}
        if (name, *filters) in tried:
            continue
        tried.add((name, *filters))
        mine = W.run_query(name, tx, acc.where(F.col("user_id") == r["user_id"]), X.BANK_AS_OF, config["time_range"], filters)
        want = [json.loads(p["point"]) for p in W.widget_points(name, mine).orderBy("_o").collect()]
        assert json.loads(out[r["widget_id"]]["config"])["customProps"]["data"] == want, config
    assert len(tried) >= 8


def test_one_scan_of_the_transactions(spark, small_dir):
    base = R.daily_base(X.transactions(spark, small_dir), X.BANK_AS_OF)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<o_orderkey") == 1 and "IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    goals = X.goals(spark, small_dir)
    assert G.savings_progress(goals, X.accounts(spark, small_dir), goals.select("goal_id", F.lit(1).alias("_sum")).limit(0)).count() > 0
