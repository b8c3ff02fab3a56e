"""Money analytics for every user at once.

The reference answers one user per call; each function here answers all
users in one job.  Two rules keep the plans scale-safe:

* Aggregate before joining.  Transactions are the big table; they are
  partially aggregated per account (map-side combine) before the join that
  maps accounts to users, so the join and the user-level shuffle move one row
  per (account, key) instead of one per transaction.
* No per-user window over raw rows.  Per-user statistics come from a
  ``groupBy`` (partial aggregation absorbs a hot user) joined back; per-user
  top-k uses ``row_number() <= k``, which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import (fmt_day, fmt_month, in_period, label, largest_period, money, month_spine,
                                summary_period, time_range, ts_lit)


# ---------------------------------------------------------------- filters

def for_user(df: DataFrame, ids, col: str = "user_id") -> DataFrame:
    """Scope to one or more users: a literal id list, or a frame of ids (semi-join, any size)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    ids = [ids] if not isinstance(ids, (list, tuple, set)) else list(ids)
    return df.filter(F.col(col).isin(ids))


def topn(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in ``order`` (TakeOrderedAndProject: n per partition, then merged)."""
    return df.orderBy(*order).limit(n)


def apply_filters(tx: DataFrame, acc: DataFrame, filters: dict | None) -> tuple[DataFrame, DataFrame]:
    """Optional category list, account id and account type filters."""
    f = filters or {}
    if f.get("categories"):
        tx = tx.filter(F.col("category").isin(list(f["categories"])))
    if f.get("account_id") is not None:
        acc = acc.filter(F.col("account_id") == F.lit(f["account_id"]))
    if f.get("account_type"):
        acc = acc.filter(F.col("account_type") == F.lit(f["account_type"]))
    return tx, acc


def user_scope(tx: DataFrame, acc: DataFrame, side: str = "from") -> DataFrame:
    """Transactions whose ``side`` account belongs to a user, with that user_id.

    The reference fetches the user's account ids and sends a literal IN list;
    here it is one equi-join.  Catalyst / AQE pick broadcast when the account
    side is small at run time and a shuffle join otherwise.
    """
    key = "from_account_id" if side == "from" else "to_account_id"
    a = acc.select(F.col("account_id").alias("_acct"), "user_id")
    return tx.join(a, tx[key] == a["_acct"], "inner").drop("_acct")


def _per_user(tx: DataFrame, acc: DataFrame, account_col: Column, keys: list[Column | str],
              aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregate per (account, keys) first, then map accounts to users and re-aggregate.

    ``aggs`` maps output name -> (kind, column) with kind in sum / count / max / min
    (all decomposable, so the two-level result equals the one-level result).
    """
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    first = []
    for name, (kind, c) in aggs.items():
        fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
        first.append(fn(c).alias(name))
    pre = tx.groupBy(account_col.alias("_acct"), *key_cols).agg(*first)
    a = acc.select(F.col("account_id").alias("_acct"), "user_id")
    joined = pre.join(a, "_acct")
    key_names = [c for c in pre.columns if c != "_acct" and c not in aggs]
    second = []
    for name, (kind, _) in aggs.items():
        fn = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind]
        second.append(fn(name).alias(name))
    return joined.groupBy("user_id", *key_names).agg(*second)


def _users_with_accounts(acc: DataFrame) -> DataFrame:
    return acc.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


# ---------------------------------------------------------------- widgets A1-A7
#
# Each widget query takes one range name, or a list ``ranges`` to compute many
# periods in one pass: a transaction is exploded into every period it falls in
# (behind one coarse date filter that still reaches the parquet scan) and
# ``time_range`` becomes one more grouping key.  Bulk widget refresh uses this
# so the transactions are read once per query type, not once per period.


def _bounds(as_of: datetime, ranges: list[str], month_floor: bool = False) -> list[tuple[str, datetime, datetime]]:
    out = []
    for r in ranges:
        s, e = time_range(r, as_of)
        out.append((r, datetime(s.year, s.month, 1) if month_floor else s, e))
    return out


def _in_periods(tx: DataFrame, as_of: datetime, ranges: list[str], month_floor: bool = False) -> DataFrame:
    """Rows of ``tx`` tagged with each period (``time_range``) whose [start, end] holds ``created_at``."""
    b = _bounds(as_of, ranges, month_floor)
    t = tx.filter(in_period("created_at", min(x[1] for x in b), max(x[2] for x in b)))
    if len(b) == 1:
        return t.withColumn("time_range", F.lit(b[0][0]))
    periods = F.array(*[F.struct(F.lit(r).alias("r"), ts_lit(s).alias("s"), ts_lit(e).alias("e")) for r, s, e in b])
    hits = F.filter(periods, lambda p: F.col("created_at").between(p["s"], p["e"]))
    return t.withColumn("time_range", F.explode(F.transform(hits, lambda p: p["r"])))


def _month_spines(as_of: datetime, ranges: list[str]) -> Column:
    """Map time_range -> array of its month starts (the zero-fill spine of each period)."""
    return F.create_map(*[x for r in ranges for x in (F.lit(r), month_spine(*time_range(r, as_of)))])


def _spine(users: DataFrame, as_of: datetime, ranges: list[str]) -> DataFrame:
    per = users.select("user_id", F.explode(F.array(*[F.lit(r) for r in ranges])).alias("time_range"))
    return per.select("user_id", "time_range",
                      F.explode(F.element_at(_month_spines(as_of, ranges), F.col("time_range"))).alias("month"))


def _finish(df: DataFrame, ranges: list[str] | None) -> DataFrame:
    return df if ranges else df.drop("time_range")


def spending_by_category(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                         filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame:
    """A1: payments per user and category in the range; NULL / '' -> Uncategorized."""
    tx, acc = apply_filters(tx, acc, filters)
    pay = _in_periods(tx.filter(F.col("type") == "payment"), as_of, ranges or [range_name])
    agg = _per_user(pay, acc, F.col("from_account_id"), ["time_range", "category"], {"value": ("sum", F.col("amount"))})
    return _finish(agg.select("user_id", "time_range", label("category", "Uncategorized").alias("name"),
                              money("value").alias("value")), ranges)


def monthly_trend(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                  filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame:
    """A2: payments per user and calendar month, every month present (zero-filled)."""
    rs = ranges or [range_name]
    tx, acc = apply_filters(tx, acc, filters)
    pay = _in_periods(tx.filter(F.col("type") == "payment"), as_of, rs, month_floor=True)
    sums = _per_user(pay, acc, F.col("from_account_id"),
                     ["time_range", F.date_trunc("month", "created_at").alias("month")],
                     {"value": ("sum", F.col("amount"))})
    spine = _spine(_users_with_accounts(acc), as_of, rs)
    out = (spine.join(sums, ["user_id", "time_range", "month"], "left")
                .select("user_id", "time_range", "month", fmt_month("month").alias("name"),
                        money(F.coalesce("value", F.lit(0))).alias("value")))
    return _finish(out, ranges)


def monthly_income_expenses(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                            filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame:
    """A3: deposits into and payments out of the user's accounts per month, zero-filled."""
    rs = ranges or [range_name]
    tx, acc = apply_filters(tx, acc, filters)
    t = _in_periods(tx.filter(F.col("type").isin("deposit", "payment")), as_of, rs, month_floor=True)
    acct = F.when(F.col("type") == "deposit", F.col("to_account_id")).otherwise(F.col("from_account_id"))
    sums = _per_user(t, acc, acct, ["time_range", F.date_trunc("month", "created_at").alias("month")], {
        "income": ("sum", F.when(F.col("type") == "deposit", F.col("amount"))),
        "expenses": ("sum", F.when(F.col("type") == "payment", F.col("amount"))),
    })
    spine = _spine(_users_with_accounts(acc), as_of, rs)
    out = (spine.join(sums, ["user_id", "time_range", "month"], "left")
                .select("user_id", "time_range", "month", fmt_month("month").alias("name"),
                        money(F.coalesce("income", F.lit(0))).alias("income"),
                        money(F.coalesce("expenses", F.lit(0))).alias("expenses")))
    return _finish(out, ranges)


def account_balances(acc: DataFrame, account_type: str | None = None) -> DataFrame:
    """A4: balance per account, optional type filter."""
    if account_type:
        acc = acc.filter(F.col("account_type") == account_type)
    return acc.select("user_id", "account_id", "name", money("balance").alias("value"),
                      F.col("account_type").alias("type"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key by ``order`` (callers add a unique last key).

    ``row_number() <= k`` becomes a partial WindowGroupLimit before the shuffle,
    so a hot key sends at most k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def top_merchants(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                  limit: int = 10, filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame:
    """A5: payment sum and count per description, best ``limit`` per user."""
    tx, acc = apply_filters(tx, acc, filters)
    pay = _in_periods(tx.filter(F.col("type") == "payment"), as_of, ranges or [range_name])
    agg = _per_user(pay, acc, F.col("from_account_id"), ["time_range", "description"],
                    {"value": ("sum", F.col("amount")), "transactions": ("count", F.col("id"))})
    top = top_per(agg, ["user_id", "time_range"], [F.col("value").desc(), F.col("description").asc_nulls_last()],
                  limit)
    return _finish(top.select("user_id", "time_range", "rank", label("description", "Unknown").alias("name"),
                              money("value").alias("value"), F.col("transactions").cast("bigint").alias("transactions")),
                   ranges)


def daily_spending(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                   filters: dict | None = None, ranges: list[str] | None = None) -> DataFrame:
    """Payments per user and day."""
    tx, acc = apply_filters(tx, acc, filters)
    pay = _in_periods(tx.filter(F.col("type") == "payment"), as_of, ranges or [range_name])
    agg = _per_user(pay, acc, F.col("from_account_id"), ["time_range", F.to_date("created_at").alias("date")],
                    {"value": ("sum", F.col("amount"))})
    return _finish(agg.select("user_id", "time_range", "date", fmt_day("date").alias("name"),
                              money("value").alias("value")), ranges)


def category_trend(tx: DataFrame, acc: DataFrame, as_of: datetime, range_name: str = "last_6_months",
                   categories: list[str] | None = None, top_n: int = 5, filters: dict | None = None,
                   ranges: list[str] | None = None) -> DataFrame:
    """Month x category spending, long form, zero-filled.

    Categories are the given list, else each user's top ``top_n`` by spend in
    the range; a NULL category can take a slot and is then dropped (D11).
    ``pivot_category_trend`` turns this into the reference's wide rows.
    """
    rs = ranges or [range_name]
    tx, acc = apply_filters(tx, acc, filters)
    payments = tx.filter(F.col("type") == "payment")
    monthly = _per_user(_in_periods(payments, as_of, rs, month_floor=True), acc, F.col("from_account_id"),
                        ["time_range", "category", F.date_trunc("month", "created_at").alias("month")],
                        {"value": ("sum", F.col("amount"))})
    users = _users_with_accounts(acc)
    if categories:
        cats = users.select("user_id", F.explode(F.array(*[F.lit(r) for r in rs])).alias("time_range")) \
            .select("user_id", "time_range", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    else:
        totals = _per_user(_in_periods(payments, as_of, rs), acc, F.col("from_account_id"),
                           ["time_range", "category"], {"total": ("sum", F.col("amount"))})
        cats = (top_per(totals, ["user_id", "time_range"], [F.col("total").desc(), F.col("category").asc_nulls_first()],
                        top_n)
                .filter(F.col("category").isNotNull() & (F.col("category") != ""))
                .select("user_id", "time_range", "category"))
    grid = cats.select("user_id", "time_range", "category",
                       F.explode(F.element_at(_month_spines(as_of, rs), F.col("time_range"))).alias("month"))
    out = (grid.join(monthly, ["user_id", "time_range", "category", "month"], "left")
               .select("user_id", "time_range", "month", fmt_month("month").alias("name"), "category",
                       money(F.coalesce("value", F.lit(0))).alias("value")))
    return _finish(out, ranges)


def pivot_category_trend(long_df: DataFrame, categories: list[str]) -> DataFrame:
    """A7 wide form: one row per (user, month), one column per category (explicit values)."""
    return (long_df.groupBy("user_id", "month", "name").pivot("category", categories)
                   .agg(F.first("value")).na.fill(0.0, subset=categories))


# ---------------------------------------------------------------- summaries A8-A13

def transactions_summary(tx: DataFrame, acc: DataFrame, as_of: datetime, period: str = "this year",
                         account_name: str | None = None) -> DataFrame:
    """Total spend, top three categories and a message for users without spend."""
    start, end = summary_period(period, as_of)
    users = _users_with_accounts(acc)
    named = None
    if account_name:
        acc = acc.filter(F.col("name") == account_name)
        named = _users_with_accounts(acc).withColumn("_has", F.lit(True))
    pay = tx.filter((F.col("type") == "payment") & in_period("created_at", start, end))
    cats = _per_user(pay, acc, F.col("from_account_id"), ["category"], {"amount": ("sum", F.col("amount"))})
    ranked = cats.withColumn("rank", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.col("amount").desc(), F.col("category").asc_nulls_first())))
    per_user = ranked.groupBy("user_id").agg(
        F.sum("amount").alias("total"),
        F.count(F.lit(1)).alias("n_categories"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct(
            "rank", label("category", "Uncategorized").alias("category"),
            F.col("amount").cast("decimal(38,2)").cast("string").alias("amount"))))).alias("top"),
    )
    filt = account_name or "All Accounts"
    out = users.join(per_user, "user_id", "left")
    no_spend = F.when(F.col("total").isNull(),
                      F.lit(f"You have no spending for the period '{period}' in account '{filt}'."))
    if named is not None:          # the reference answers "not found" when the user has no such account
        out = out.join(named, "user_id", "left")
        no_spend = F.when(F.col("_has").isNull(), F.lit(f"Account '{account_name}' not found.")).otherwise(no_spend)
    return out.select(
        "user_id",
        money(F.coalesce("total", F.lit(0))).alias("total_spending"),
        F.coalesce("n_categories", F.lit(0)).cast("bigint").alias("n_categories"),
        F.array_join(F.transform(F.coalesce("top", F.array()), lambda x: x["category"]), ",").alias("top_categories"),
        F.array_join(F.transform(F.coalesce("top", F.array()), lambda x: x["amount"]), ",").alias("top_amounts"),
        F.lit(filt).alias("account_filter"),
        no_spend.alias("message"),
    )


def balance_overview(acc: DataFrame) -> DataFrame:
    """Net worth and number of accounts per user."""
    return acc.groupBy("user_id").agg(money(F.sum("balance")).alias("net_worth"),
                                      F.count(F.lit(1)).alias("n_accounts"))


def user_transactions(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Transactions touching a user on either side, once per (user, transaction).

    Both sides' owners are looked up on the same row (two equi-joins against
    the account -> user map) and the row is exploded over the distinct owners,
    so a transfer between two accounts of one user appears once without a
    de-duplication shuffle.  With a broadcastable account map (AQE decides by
    size) the transactions are not shuffled at all.
    """
    fa = acc.select(F.col("account_id").alias("_fa"), F.col("user_id").alias("_fu"))
    ta = acc.select(F.col("account_id").alias("_ta"), F.col("user_id").alias("_tu"))
    both = (tx.join(fa, tx["from_account_id"] == fa["_fa"], "left")
              .join(ta, tx["to_account_id"] == ta["_ta"], "left"))
    owners = F.array_distinct(F.filter(F.array("_fu", "_tu"), lambda u: u.isNotNull()))
    return both.select(*tx.columns, F.explode(owners).alias("user_id"))


def current_month_spending(tx: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """A10: payments in the calendar month of ``as_of`` (year and month, D7)."""
    m0 = datetime(as_of.year, as_of.month, 1)
    # filter before the per-user de-duplication so the month reaches the parquet scan
    cur = user_transactions(tx.filter((F.col("type") == "payment") & (F.col("created_at") >= ts_lit(m0))
                                      & (F.col("created_at") <= ts_lit(as_of))), acc)
    users = _users_with_accounts(acc)
    s = cur.groupBy("user_id").agg(F.sum("amount").alias("s"))
    return users.join(s, "user_id", "left").select("user_id", money(F.coalesce("s", F.lit(0))).alias("monthly_spending"))


def six_month_cashflow(tx: DataFrame, acc: DataFrame, as_of: datetime, months: int = 6) -> DataFrame:
    """Income / expenses / net for the last ``months`` calendar months (D8-safe)."""
    m_last = datetime(as_of.year, as_of.month, 1)
    from dateutil.relativedelta import relativedelta
    m_first = m_last - relativedelta(months=months - 1)
    ut = user_transactions(tx.filter(F.col("type").isin("deposit", "payment")
                                     & (F.col("created_at") >= ts_lit(m_first))
                                     & (F.col("created_at") <= ts_lit(as_of))), acc)
    sums = ut.groupBy("user_id", F.date_trunc("month", "created_at").alias("month")).agg(
        F.sum(F.when(F.col("type") == "deposit", F.col("amount"))).alias("income"),
        F.sum(F.when(F.col("type") == "payment", F.col("amount"))).alias("expenses"))
    spine = _users_with_accounts(acc).select("user_id", F.explode(month_spine(m_first, as_of)).alias("month"))
    j = spine.join(sums, ["user_id", "month"], "left")
    inc = F.coalesce("income", F.lit(0))
    exp = F.coalesce("expenses", F.lit(0))
    return j.select("user_id", "month", F.date_format("month", "MMM").alias("name"),
                    money(inc).alias("income"), money(exp).alias("expenses"), money(inc - exp).alias("net"))


def financial_insights(tx: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """Savings rate of the current month, its rating, budget alert, top category."""
    cf = six_month_cashflow(tx, acc, as_of, months=1).select("user_id", "income", "expenses")
    ut = user_transactions(tx.filter(F.col("type") == "payment"), acc)
    cats = ut.groupBy("user_id", "category").agg(F.sum("amount").alias("amount"))
    top = top_per(cats, ["user_id"], [F.col("amount").desc(), F.col("category").asc_nulls_first()], 1) \
        .select("user_id", F.col("category").alias("top_category"), money("amount").alias("top_category_amount"))
    rate = F.when(F.col("income") > 0, (F.col("income") - F.col("expenses")) / F.col("income") * 100).otherwise(0.0)
    return (cf.join(top, "user_id", "left")
              .withColumn("savings_rate", F.round(rate, 6))
              .select("user_id", "income", "expenses", "savings_rate",
                      F.when(F.col("savings_rate") > 20, "Excellent").when(F.col("savings_rate") > 10, "Good")
                       .otherwise("Needs Improvement").alias("rating"),
                      F.when(F.col("expenses") > F.col("income") * 0.8, "Consider reducing expenses")
                       .otherwise("On track").alias("budget"),
                      "top_category", "top_category_amount"))


def totals_by_type(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Income (deposits), expenses (payments), transfers per user."""
    ut = user_transactions(tx, acc)
    return ut.groupBy("user_id").agg(
        money(F.coalesce(F.sum(F.when(F.col("type") == "deposit", F.col("amount"))), F.lit(0))).alias("total_income"),
        money(F.coalesce(F.sum(F.when(F.col("type") == "payment", F.col("amount"))), F.lit(0))).alias("total_expenses"),
        money(F.coalesce(F.sum(F.when(F.col("type") == "transfer", F.col("amount"))), F.lit(0))).alias("total_transfers"),
    )


def search_transactions(ut: DataFrame, q: str = "", tx_type: str | None = None, category: str | None = None,
                        account_id=None) -> DataFrame:
    """Case-insensitive contains on description OR category, AND the facets."""
    ql = q.lower()
    cond = F.lower(F.coalesce("description", F.lit(""))).contains(ql) | \
        F.lower(F.coalesce("category", F.lit(""))).contains(ql)
    if tx_type:
        cond = cond & (F.col("type") == tx_type)
    if category:
        cond = cond & (F.col("category") == category)
    if account_id is not None:
        cond = cond & (F.col("from_account_id") == F.lit(account_id))
    return ut.filter(cond)


def facets(ut: DataFrame) -> DataFrame:
    """Distinct categories and types per user (long form)."""
    return (ut.select("user_id", F.lit("category").alias("facet"), F.col("category").alias("value"))
              .unionByName(ut.select("user_id", F.lit("type").alias("facet"), F.col("type").alias("value")))
              .distinct())


def with_account_names(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Both account names on a transaction (role-playing dimension), External when absent."""
    fa = acc.select(F.col("account_id").alias("_fa"), F.col("name").alias("_fname"))
    ta = acc.select(F.col("account_id").alias("_ta"), F.col("name").alias("_tname"))
    return (tx.join(fa, tx["from_account_id"] == fa["_fa"], "left")
              .join(ta, tx["to_account_id"] == ta["_ta"], "left")
              .withColumn("from_account", F.coalesce("_fname", F.lit("External")))
              .withColumn("to_account", F.coalesce("_tname", F.lit("External")))
              .drop("_fa", "_ta", "_fname", "_tname"))


def largest_transaction(tx: DataFrame, acc: DataFrame, as_of: datetime, period: str = "all time",
                        category: str | None = None, tx_type: str | None = None, side: str = "from") -> DataFrame:
    """Each user's largest transaction (scan of the from side only, D15; side='either' widens)."""
    start, end = largest_period(period, as_of)
    t = tx.filter(in_period("created_at", start, end))
    if category:
        t = t.filter(F.col("category") == category)
    if tx_type:
        t = t.filter(F.col("type") == tx_type)
    scoped = user_transactions(t, acc) if side == "either" else user_scope(t, acc, "from")
    best = top_per(scoped, ["user_id"], [F.col("amount").desc(), F.col("id").asc()], 1).drop("rank")
    named = with_account_names(best, acc)
    found = named.select("user_id", F.col("id").alias("transaction_id"), money("amount").alias("amount"),
                         fmt_day("created_at").alias("date"), "description", "category", "type",
                         "from_account", "to_account", "status")
    # every user with accounts gets an answer; no match -> the reference's message
    out = _users_with_accounts(acc).join(found, "user_id", "left")
    return out.withColumn("message", F.when(F.col("transaction_id").isNull(),
                                            F.lit("No transactions found for the specified criteria")))


def recent_transactions(tx: DataFrame, acc: DataFrame, k: int = 5) -> DataFrame:
    """T4: newest ``k`` transactions per user (either side), ties by id."""
    ut = user_transactions(tx, acc)
    top = top_per(ut, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], k)
    return top.select("user_id", "rank", "id", "created_at", "description", "category", "type",
                      money(F.when(F.col("type") == "payment", -F.col("amount")).otherwise(F.col("amount")))
                      .alias("signed_amount"))


def top_categories(tx: DataFrame, acc: DataFrame, k: int = 6) -> DataFrame:
    """T5: the user's ``k`` largest payment categories (client-side pie chart)."""
    ut = user_transactions(tx.filter(F.col("type") == "payment"), acc)
    cats = ut.groupBy("user_id", "category").agg(F.sum("amount").alias("amount"))
    top = top_per(cats, ["user_id"], [F.col("amount").desc(), F.col("category").asc_nulls_first()], k)
    return top.select("user_id", "rank", "category", money("amount").alias("amount"))


def spending_insight(tx: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """Per category this month: amount, share of the user's total, trend vs last month."""
    from dateutil.relativedelta import relativedelta
    m_cur = datetime(as_of.year, as_of.month, 1)
    m_prev = m_cur - relativedelta(months=1)
    pay = tx.filter((F.col("type") == "payment") & (F.col("created_at") >= ts_lit(m_prev))
                    & (F.col("created_at") <= ts_lit(as_of)))
    is_cur = F.col("created_at") >= ts_lit(m_cur)
    agg = _per_user(pay, acc, F.col("from_account_id"), ["category"], {
        "cur": ("sum", F.when(is_cur, F.col("amount"))),
        "prev": ("sum", F.when(~is_cur, F.col("amount"))),
    }).filter(F.col("cur").isNotNull())
    tot = agg.groupBy("user_id").agg(F.sum("cur").alias("_tot"))
    j = agg.join(tot, "user_id")
    prev = F.coalesce("prev", F.lit(0))
    return j.select("user_id", label("category", "Uncategorized").alias("category"), money("cur").alias("amount"),
                    F.round((F.col("cur") / F.col("_tot") * 100).cast("double"), 4).alias("percentage"),
                    F.when(F.col("cur") > prev, "up").when(F.col("cur") < prev, "down").otherwise("stable")
                     .alias("trend"))


def validate_transfers(req: DataFrame, acc: DataFrame) -> DataFrame:
    """(user_id, from_name, to_name, amount) requests -> status and message, in the reference's order."""
    fa = acc.select(F.col("user_id").alias("_fu"), F.col("name").alias("_fn"), F.col("balance").alias("_fb"))
    ta = acc.select(F.col("user_id").alias("_tu"), F.col("name").alias("_tn"))
    fa = fa.groupBy("_fu", "_fn").agg(F.min("_fb").alias("_fb"))  # names are unique per user
    ta = ta.groupBy("_tu", "_tn").agg(F.count(F.lit(1)).alias("_tc"))
    j = (req.join(fa, (req["user_id"] == fa["_fu"]) & (req["from_account_name"] == fa["_fn"]), "left")
            .join(ta, (req["user_id"] == ta["_tu"]) & (req["to_account_name"] == ta["_tn"]), "left"))
    msg = (F.when(F.col("from_account_name").isNull() | F.col("to_account_name").isNull() | (F.col("amount") <= 0),
                  "Missing required transfer details.")
            .when(F.col("_fn").isNull(), F.concat(F.lit("Account '"), F.col("from_account_name"), F.lit("' not found.")))
            .when(F.col("_fb") < F.col("amount"), "Insufficient funds.")
            .when(F.col("_tn").isNull(), F.concat(F.lit("Recipient account '"), F.col("to_account_name"),
                                                 F.lit("' not found."))))
    return j.select(*req.columns, F.when(msg.isNull(), "success").otherwise("error").alias("status"),
                    F.coalesce(msg, F.lit("Transfer successful")).alias("message"))


# ---------------------------------------------------------------- business questions A33-A38

def net_cash_flow(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Money in minus money out per user (completed or not), with a rank (1 = highest)."""
    a = acc.select(F.col("account_id").alias("_acct"), "user_id")
    inflow = tx.groupBy(F.col("to_account_id").alias("_acct")).agg(F.sum("amount").alias("inflow"))
    outflow = tx.groupBy(F.col("from_account_id").alias("_acct")).agg(F.sum("amount").alias("outflow"))
    per_acct = a.join(inflow, "_acct", "left").join(outflow, "_acct", "left")
    per_user = per_acct.groupBy("user_id").agg(F.sum(F.coalesce("inflow", F.lit(0))).alias("i"),
                                               F.sum(F.coalesce("outflow", F.lit(0))).alias("o"))
    return per_user.select("user_id", money("i").alias("inflow"), money("o").alias("outflow"),
                           money(F.col("i") - F.col("o")).alias("net_cash_flow"))


def balance_by_type(acc: DataFrame) -> DataFrame:
    """Total balance and account count per account type."""
    return acc.groupBy("account_type").agg(money(F.sum("balance")).alias("total_balance"),
                                           F.count(F.lit(1)).alias("n_accounts"))


def active_users(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Users with at least one outgoing transaction, and the mean amount."""
    s = user_scope(tx, acc, "from")
    return s.agg(F.countDistinct("user_id").alias("active_users"),
                 F.round(F.avg(F.col("amount").cast("double")), 4).alias("avg_amount"),
                 F.count(F.lit(1)).alias("n_transactions"))


def status_totals(tx: DataFrame) -> DataFrame:
    """Amount and count per status."""
    return tx.groupBy("status").agg(money(F.sum("amount")).alias("total_amount"), F.count(F.lit(1)).alias("n"))


def credit_outstanding(acc: DataFrame, credit_limit: float = 10000.0) -> DataFrame:
    """Outstanding credit per user and utilisation against a limit parameter."""
    c = acc.filter(F.col("account_type") == "credit")
    per_user = c.groupBy("user_id").agg(F.sum(F.abs("balance")).alias("o"), F.count(F.lit(1)).alias("n_credit"))
    return per_user.select("user_id", money("o").alias("outstanding"), "n_credit",
                           F.round(F.col("o").cast("double") / (F.col("n_credit") * credit_limit) * 100, 6)
                           .alias("utilisation_pct"))


def spend_by_category_all(tx: DataFrame) -> DataFrame:
    """Payments by category over all users."""
    p = tx.filter(F.col("type") == "payment")
    return p.groupBy("category").agg(money(F.sum("amount")).alias("total_spent"), F.count(F.lit(1)).alias("n"))
