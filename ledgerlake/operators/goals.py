"""Goal progress for every goal at once.

A goal row carries its user, type and parameters (target, linked account
name, category, deadline).  Progress needs per-user account totals and, for a
linked account, one lookup by (user_id, name); both are joins on keys, never a
per-goal query.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import in_period, money, time_range, ts_lit


def _pct(num: Column, den: Column) -> Column:
    """min(100, num / den * 100) when den > 0 else 0, rounded to one place."""
    raw = F.when(den > 0, F.least(F.lit(100.0), num.cast("double") / den.cast("double") * 100)).otherwise(F.lit(0.0))
    return F.round(raw, 1)


def named_accounts(acc: DataFrame) -> DataFrame:
    """_u, _n, _linked_id, _linked_bal: the first account of each name per user."""
    named = (acc.groupBy(F.col("user_id").alias("_u"), F.col("name").alias("_n"))
                .agg(F.min("account_id").alias("_linked_id")))
    return named.join(acc.select(F.col("account_id").alias("_linked_id"), F.col("balance").alias("_linked_bal")),
                      "_linked_id")


def _linked(goals: DataFrame, acc: DataFrame) -> DataFrame:
    """Goals joined to the account they name (first account with that name per user)."""
    named = named_accounts(acc)
    return goals.join(named, (goals["user_id"] == named["_u"]) & (goals["linked_account_name"] == named["_n"]), "left") \
                .drop("_u", "_n")


def _type_totals(acc: DataFrame, account_type: str, name: str, absolute: bool = False) -> DataFrame:
    bal = F.abs("balance") if absolute else F.col("balance")
    return (acc.filter(F.col("account_type") == account_type)
               .groupBy(F.col("user_id").alias("_u2")).agg(F.sum(bal).alias(name)))


def goal_savings(goals: DataFrame, acc: DataFrame, tx: DataFrame, as_of: datetime) -> DataFrame:
    """Savings progress; named account, else all savings; 30-day contributions for a named account."""
    since = as_of - timedelta(days=30)
    contrib = (tx.filter(F.col("type").isin("deposit", "transfer") & in_period("created_at", since, as_of))
                 .groupBy(F.col("to_account_id").alias("_acct")).agg(F.sum("amount").alias("_sum")))
    named = _linked(goals.filter(F.col("goal_type") == "savings"), acc)
    return savings_progress(goals, acc, named.join(contrib, named["_linked_id"] == contrib["_acct"]).select("goal_id", "_sum"))


def savings_progress(goals: DataFrame, acc: DataFrame, contributions: DataFrame) -> DataFrame:
    """A14 from ``contributions`` (goal_id, _sum) that are summed up already."""
    g = _linked(goals.filter(F.col("goal_type") == "savings"), acc)
    totals = _type_totals(acc, "savings", "_all_savings")
    g = g.join(totals, g["user_id"] == totals["_u2"], "left").drop("_u2")
    g = g.join(contributions.select("goal_id", F.col("_sum").alias("_contrib")), "goal_id", "left")
    linked = F.col("linked_account_name").isNotNull()
    current = F.when(linked, F.coalesce("_linked_bal", F.lit(0))).otherwise(F.coalesce("_all_savings", F.lit(0)))
    target = F.col("target_amount")
    return g.select(
        "goal_id", "user_id",
        money(current).alias("current_amount"), money(target).alias("target_amount"),
        _pct(current, target).alias("progress_percent"),
        money(F.greatest(F.lit(0), target - current)).alias("remaining"),
        F.when(linked, F.col("linked_account_name")).otherwise(F.lit("All Savings")).alias("account_name"),
        money(F.when(linked & F.col("_linked_id").isNotNull(), F.coalesce("_contrib", F.lit(0))).otherwise(F.lit(0)))
        .alias("recent_contributions"),
    )


def goal_debt(goals: DataFrame, acc: DataFrame) -> DataFrame:
    """Debt payoff progress (amount paid off against the original debt)."""
    g = _linked(goals.filter(F.col("goal_type") == "debt_payoff"), acc)
    totals = _type_totals(acc, "credit", "_all_credit", absolute=True)
    g = g.join(totals, g["user_id"] == totals["_u2"], "left").drop("_u2")
    linked = F.col("linked_account_name").isNotNull()
    current = F.when(linked, F.coalesce(F.abs("_linked_bal"), F.lit(0))).otherwise(F.coalesce("_all_credit", F.lit(0)))
    orig = F.col("original_debt")
    paid = F.greatest(F.lit(0), orig - current)
    return g.select(
        "goal_id", "user_id", money(current).alias("current_debt"), money(orig).alias("original_debt"),
        money(paid).alias("amount_paid"), _pct(paid, orig).alias("progress_percent"),
        F.when(linked, F.col("linked_account_name")).otherwise(F.lit("All Credit")).alias("account_name"),
    )


def goal_spending_limit(goals: DataFrame, tx: DataFrame, acc: DataFrame, as_of: datetime,
                        range_name: str = "this_month") -> DataFrame:
    """Spend in the range (optionally one category) against the limit."""
    start, end = time_range(range_name, as_of)
    g = goals.filter(F.col("goal_type") == "spending_limit")
    pay = tx.filter((F.col("type") == "payment") & in_period("created_at", start, end))
    # spend per (account, category) first, then per (user, category): small, no per-goal scan
    per_acct = pay.groupBy(F.col("from_account_id").alias("_acct"), "category").agg(F.sum("amount").alias("_s"))
    a = acc.select(F.col("account_id").alias("_acct"), F.col("user_id").alias("_u"))
    per_user_cat = per_acct.join(a, "_acct").groupBy("_u", F.col("category").alias("_c")).agg(F.sum("_s").alias("_s"))
    per_user = per_user_cat.groupBy("_u").agg(F.sum("_s").alias("_all"))
    has_acc = acc.groupBy(F.col("user_id").alias("_ua")).agg(F.count(F.lit(1)).alias("_nacc"))
    j = (g.join(per_user, g["user_id"] == per_user["_u"], "left").drop("_u")
          .join(per_user_cat, (g["user_id"] == per_user_cat["_u"]) & (g["category"] == per_user_cat["_c"]), "left")
          .drop("_u", "_c")
          .join(has_acc, g["user_id"] == has_acc["_ua"], "left"))
    return limit_progress(j, F.when(F.col("category").isNotNull(), F.coalesce("_s", F.lit(0))).otherwise(F.coalesce("_all", F.lit(0))))


def limit_progress(goals: DataFrame, spent: Column) -> DataFrame:
    """A16 of goals whose spending is the column ``spent``."""
    lim = F.col("spending_limit")
    return goals.select(
        "goal_id", "user_id", money(spent).alias("current_spending"), money(lim).alias("spending_limit"),
        money(F.greatest(F.lit(0), lim - spent)).alias("remaining"), _pct(spent, lim).alias("progress_percent"),
        F.coalesce("category", F.lit("All Categories")).alias("category"),
        (spent > lim).alias("is_over_budget"),
    )


def goal_status(progress: DataFrame, goals: DataFrame, as_of: datetime) -> DataFrame:
    """Days to the deadline (ceil) and the progress band the UI colours by."""
    g = goals.select(F.col("goal_id").alias("_g"), "goal_type", "deadline")
    j = progress.join(g, progress["goal_id"] == g["_g"]).drop("_g")
    secs = F.unix_timestamp(F.col("deadline").cast("timestamp_ntz").cast("timestamp")) - \
        F.unix_timestamp(ts_lit(as_of).cast("timestamp"))
    p = F.col("progress_percent")
    band = (F.when(F.col("goal_type") == "spending_limit",
                   F.when(p >= 100, "red").when(p >= 80, "amber").otherwise("green"))
             .otherwise(F.when(p >= 100, "green").when(p >= 50, "blue").otherwise("indigo")))
    return j.select("goal_id", "user_id", "goal_type", "progress_percent",
                    F.when(F.col("deadline").isNotNull(), F.ceil(secs / 86400.0)).alias("days_remaining"),
                    band.alias("band"))
