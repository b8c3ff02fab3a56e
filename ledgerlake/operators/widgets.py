"""Stored dashboard widgets: one query by name for all users, points, counts, config update.

The refresh of all stored widgets, each with its own filters, is in ``refresh``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fmt_day, fmt_month, in_period, label, money, ts_lit
from . import banking as B
from . import goals as G

# Chart query types, goal query types and simulation types of the reference.
CHART_QUERIES = ["spending_by_category", "monthly_trend", "monthly_income_expenses", "account_balances",
                 "top_merchants", "daily_spending", "category_trend"]
GOAL_QUERIES = ["goal_savings_progress", "goal_debt_payoff_progress", "goal_spending_limit"]
SIMULATIONS = ["loan_repayment", "savings_projector", "budget_planner", "retirement_calculator", "emergency_fund"]

def run_query(name: str, tx: DataFrame, acc: DataFrame, as_of: datetime, time_range: str = "last_6_months",
              filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame | None:
    """V7: dispatch a widget query by name; unknown names give None (the reference returns []).

    With ``ranges`` the result carries ``time_range`` and covers all of them in one pass.
    """
    f = filters or {}
    if name == "spending_by_category":
        return B.spending_by_category(tx, acc, as_of, time_range, f, ranges=ranges)
    if name == "monthly_trend":
        return B.monthly_trend(tx, acc, as_of, time_range, f, ranges=ranges)
    if name == "monthly_income_expenses":
        return B.monthly_income_expenses(tx, acc, as_of, time_range, f, ranges=ranges)
    if name == "account_balances":
        out = B.account_balances(acc, f.get("account_type"))
        return out.withColumn("time_range", F.explode(F.array(*[F.lit(r) for r in ranges]))) if ranges else out
    if name == "top_merchants":
        return B.top_merchants(tx, acc, as_of, time_range, int(f.get("limit", 10)), f, ranges=ranges)
    if name == "daily_spending":
        return B.daily_spending(tx, acc, as_of, time_range, f, ranges=ranges)
    if name == "category_trend":
        return B.category_trend(tx, acc, as_of, time_range, f.get("categories"), filters=f, ranges=ranges)
    return None


def run_goal(name: str, goals: DataFrame, tx: DataFrame, acc: DataFrame, as_of: datetime,
             time_range: str = "this_month") -> DataFrame | None:
    """V7 (goals): the three goal queries by name."""
    if name == "goal_savings_progress":
        return G.goal_savings(goals, acc, tx, as_of)
    if name == "goal_debt_payoff_progress":
        return G.goal_debt(goals, acc)
    if name == "goal_spending_limit":
        return G.goal_spending_limit(goals, tx, acc, as_of, time_range)
    return None


# Sort key of the points of each query type (the order the reference returns them in).
def _point_order(name: str) -> Column:
    if name in ("monthly_trend", "monthly_income_expenses", "category_trend"):
        return F.struct(F.col("month").cast("string").alias("a"), F.coalesce(F.col("category"), F.lit("")).alias("b")) \
            if name == "category_trend" else F.struct(F.col("month").cast("string").alias("a"), F.lit("").alias("b"))
    if name == "daily_spending":
        return F.struct(F.col("date").cast("string").alias("a"), F.lit("").alias("b"))
    if name == "top_merchants":
        return F.struct(F.lpad(F.col("rank").cast("string"), 6, "0").alias("a"), F.lit("").alias("b"))
    if name == "account_balances":
        return F.struct(F.col("account_id").cast("string").alias("a"), F.lit("").alias("b"))
    # spending_by_category: value descending
    return F.struct(F.format_string("%020.2f", F.lit(1e15) - F.col("value")).alias("a"), F.col("name").alias("b"))


def widget_points(name: str, result: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(user_id[, time_range] or the ``keep`` columns, order, point JSON) for one query result; the JSON carries the chart fields."""
    keep = keep or ["user_id"] + (["time_range"] if "time_range" in result.columns else [])
    if name == "category_trend":
        return wide_points(result, keep=keep)
    drop = {"user_id", "month", "date", "rank", "account_id", "time_range", *keep}
    fields = [c for c in result.columns if c not in drop]
    return result.select(*keep, _point_order(name).alias("_o"), F.to_json(F.struct(*fields)).alias("point"))


def wide_points(result: DataFrame, months: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Points of category_trend: one per month, its name and a member for each category.

    ``months`` (the ``keep`` columns and month) adds the months without spending.
    """
    keep = keep or ["user_id"] + (["time_range"] if "time_range" in result.columns else [])
    by_month = result.groupBy(*keep, "month").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "value")))).alias("_v"))
    if months is not None:
        by_month = months.join(by_month, [*keep, "month"], "left")
    name = F.to_json(F.struct(fmt_month("month").alias("name")))
    values = F.to_json(F.coalesce("_v", F.create_map().cast("map<string,double>")))
    point = F.when(values == "{}", name).otherwise(F.concat(F.rtrim(name, F.lit("}")), F.lit(","), F.ltrim(values, F.lit("{"))))
    return by_month.select(*keep, F.struct(F.col("month").cast("string").alias("a"), F.lit("").alias("b")).alias("_o"),
                           point.alias("point"))


def set_widget_json(config: Column, data: Column) -> Column:
    """config JSON with ``customProps.data`` replaced by the JSON text ``data`` (customProps created if absent).

    Every other member of the config and of customProps stays, whatever its
    type.  A config that is null or no JSON object is returned as it is.
    """
    members = F.try_parse_json(config).try_cast("map<string,variant>")
    props = F.coalesce(members["customProps"].try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    props = F.map_concat(F.map_filter(props, lambda k, v: k != "data"), F.create_map(F.lit("data"), F.parse_json(data)))
    whole = F.map_concat(F.map_filter(members, lambda k, v: k != "customProps"),
                         F.create_map(F.lit("customProps"), F.call_function("to_variant_object", props)))
    return F.coalesce(F.to_json(whole), config)


def set_widget_data(config: Column, data: Column) -> Column:
    """the same with an array of JSON objects, one per point and in order."""
    return set_widget_json(config, F.concat(F.lit("["), F.array_join(data, ","), F.lit("]")))


def widget_counts(widgets: DataFrame) -> DataFrame:
    """Widgets per user: all, charts (anything not a simulation), simulations."""
    is_sim = F.col("widget_type") == "simulation"
    return widgets.groupBy("user_id").agg(F.count(F.lit(1)).alias("all_widgets"),
                                          F.count_if(~is_sim).alias("charts"),
                                          F.count_if(is_sim).alias("simulations"))


def list_widgets(widgets: DataFrame) -> DataFrame:
    """T6 (widgets): each user's widgets, most recently updated first."""
    from .ordering import ordinal_within
    keyed = widgets.select("user_id", "widget_id", "updated_at",
                           (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("_k1"),
                           (-F.col("widget_id")).alias("_k2"))
    return ordinal_within(keyed, "user_id", ["_k1", "_k2"], "rank").drop("_k1", "_k2")
