"""All widget queries of all users in one pass over the transactions.

A request is a user's query configuration: query type, time range and filters.
Equal requests are one filter set, which is spread over the accounts, transaction
types and categories that it admits.  The transactions are read and aggregated
once (per account, type, category, description and day); each row of that finds
the sets that admit it by an equi-join on account, type and category, and the
points of every chart and goal come from the sums per set.  Nothing is listed on
the driver, and no filter is applied per widget.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fmt_day, fmt_month, in_period, label, money, time_range, ts_lit
from . import banking as B
from . import goals as G
from .widgets import CHART_QUERIES, GOAL_QUERIES, set_widget_json, wide_points, widget_points

#: The members of a stored query configuration that the queries look at.
CONFIG = ("struct<query_type: string, time_range: string, filters: struct<account_id: bigint, account_type: string, "
          "categories: array<string>, limit: int, category: string, target_amount: decimal(15,2), original_debt: decimal(15,2), "
          "spending_limit: decimal(15,2), linked_account_name: string>>")

# The named time ranges; any other name means the first.
RANGES = ["last_6_months", "last_3_months", "last_12_months", "last_year", "this_year", "this_month", "last_30_days",
          "last_7_days", "all_time"]

MONTHLY = ["monthly_trend", "monthly_income_expenses", "category_trend"]
#: Transaction types that a query type sums up, by the account on their own side.
TYPES = {"monthly_income_expenses": ["payment", "deposit"],
         **{q: ["payment"] for q in ("spending_by_category", "monthly_trend", "top_merchants", "daily_spending", "category_trend",
                                     "goal_spending_limit")}}
TOP_MERCHANTS, TOP_CATEGORIES = 10, 5


def requests(configs: DataFrame) -> DataFrame:
    """``configs`` (user_id, query_config JSON, others) with what the configuration asks for and its set_id.

    As stored values go, 0, an empty text and an empty list are no filter.  A
    missing query type means spending_by_category; a text that is no JSON object
    asks for nothing (query_type null).
    """
    # reading a configuration takes long beside listing it, so that is dealt to all tasks
    n = int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = configs.repartition(n, "user_id", "query_config").withColumn("_c", F.from_json("query_config", CONFIG)) \
        .withColumn("_ok", F.try_parse_json("query_config").try_cast("map<string,variant>").isNotNull())
    f = F.col("_c.filters")
    cats = F.array_sort(F.array_distinct(F.filter(F.coalesce(f["categories"], F.array().cast("array<string>")), lambda c: c.isNotNull())))
    query = F.when(F.col("_ok"), F.coalesce(F.col("_c.query_type"), F.lit("spending_by_category")))
    name = F.col("_c.time_range")
    fields = {"query_type": query, "period": F.when(name.isin(RANGES), name).otherwise(RANGES[0]),
              "account_id": F.nullif(f["account_id"], F.lit(0)), "account_type": F.nullif(f["account_type"], F.lit("")),
              "categories": cats, "limit": F.coalesce(f["limit"], F.lit(TOP_MERCHANTS)), "category": F.nullif(f["category"], F.lit("")),
              "linked_account_name": F.nullif(f["linked_account_name"], F.lit("")),
              **{c: F.coalesce(f[c], F.lit(0)).cast("decimal(15,2)") for c in ("target_amount", "original_debt", "spending_limit")}}
    asked = parsed.withColumn("q", F.struct("user_id", *[v.alias(k) for k, v in fields.items()])).drop("_c", "_ok")
    # never null, and known to be so: a join on it needs no filter, which would be worked out before the rows are dealt
    return asked.withColumn("set_id", F.coalesce(F.sha2(F.to_json("q").cast("binary"), 256), F.lit("")))


def _eras(as_of: datetime) -> tuple[list[datetime], dict[str, int], dict[str, int]]:
    """All starts of periods in order, and by period the number of its start and of its first month's start.

    All periods end at ``as_of``, so a row lies in one if its era, the number of
    starts that aren't after it, is at least the period's.
    """
    exact = {r: time_range(r, as_of)[0] for r in RANGES}
    floor = {r: datetime(s.year, s.month, 1) for r, s in exact.items()}
    starts = sorted({*exact.values(), *floor.values()})
    return starts, {r: starts.index(s) + 1 for r, s in exact.items()}, {r: starts.index(s) + 1 for r, s in floor.items()}


def _by_period(values: dict[str, int], period: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), period)


def daily_base(tx: DataFrame, as_of: datetime) -> DataFrame:
    """The one aggregate of the transactions: value and n per (acct, type, category, description, date, era)."""
    starts = _eras(as_of)[0]
    rows = tx.where(F.col("type").isin("payment", "deposit", "transfer") & in_period("created_at", starts[0], as_of))
    acct = F.when(F.col("type") == "payment", F.col("from_account_id")).otherwise(F.col("to_account_id"))
    era = sum((F.col("created_at") >= ts_lit(s)).cast("int") for s in starts)
    return rows.groupBy(acct.alias("acct"), "type", "category", "description", F.to_date("created_at").alias("date"), era.alias("era")) \
        .agg(F.sum("amount").alias("value"), F.count(F.lit(1)).alias("n"))


def _cat_key(category: Column) -> Column:
    return F.concat(F.lit("="), category)


def admitted(sets: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """Every (acct, type, cat_key) that a filter set admits, with the first era it counts; ``*`` stands for any category."""
    _, exact, floor = _eras(as_of)
    any_cat = F.array(F.lit("*"))
    types = F.element_at(F.create_map(*[x for q, t in TYPES.items() for x in (F.lit(q), F.array(*[F.lit(v) for v in t]))]), F.col("q.query_type"))
    cats = F.when(F.col("q.query_type").isin("spending_by_category", "category_trend") & (F.size("q.categories") > 0),
                  F.transform("q.categories", _cat_key)) \
        .when((F.col("q.query_type") == "goal_spending_limit") & F.col("q.category").isNotNull(), F.array(_cat_key(F.col("q.category")))) \
        .otherwise(any_cat)
    own = acc.select(F.col("account_id").alias("acct"), F.col("user_id").alias("_u"))
    of_query = [F.col("q.query_type").alias("query_type"), F.col("q.period").alias("period"), F.col("q.categories").alias("categories"),
                F.col("q.limit").alias("limit")]
    charts = sets.where(F.col("q.query_type").isin(list(TYPES))).join(own, F.col("q.user_id") == F.col("_u")) \
        .where(F.coalesce(F.col("q.account_id") == F.col("acct"), F.lit(True))) \
        .select("set_id", *of_query, "acct", types.alias("types"), cats.alias("cats"), _by_period(exact, F.col("q.period")).alias("exact_era"),
                F.when(F.col("q.query_type").isin(MONTHLY), _by_period(floor, F.col("q.period")))
                .otherwise(_by_period(exact, F.col("q.period"))).alias("least_era"))
    named = G.named_accounts(acc).select(F.col("_u"), F.col("_n"), F.col("_linked_id").alias("acct"))
    saving = sets.where((F.col("q.query_type") == "goal_savings_progress")) \
        .join(named, (F.col("q.user_id") == F.col("_u")) & (F.col("q.linked_account_name") == F.col("_n"))) \
        .select("set_id", *of_query, "acct", F.array(F.lit("deposit"), F.lit("transfer")).alias("types"), any_cat.alias("cats"),
                F.lit(exact["last_30_days"]).alias("exact_era"), F.lit(exact["last_30_days"]).alias("least_era"))
    return charts.unionByName(saving).withColumn("type", F.explode("types")).withColumn("cat_key", F.explode("cats")).drop("types", "cats")


def sums(base: DataFrame, index: DataFrame) -> DataFrame:
    """value and n per set and point: set_id, query_type, limit, given, type, in_period, g_category, g_description, g_date."""
    facts = base.withColumn("cat_key", F.explode(F.array_compact(F.array(F.lit("*"), _cat_key(F.col("category"))))))
    hits = facts.join(index, ["acct", "type", "cat_key"]).where(F.col("era") >= F.col("least_era"))
    query = F.col("query_type")
    return hits.groupBy(
        "set_id", "query_type", "limit", (F.size("categories") > 0).alias("given"), "type", (F.col("era") >= F.col("exact_era")).alias("in_period"),
        F.when(query.isin("spending_by_category", "category_trend"), F.col("category")).alias("g_category"),
        F.when(query == "top_merchants", F.col("description")).alias("g_description"),
        F.when(query == "daily_spending", F.col("date")).when(query.isin(MONTHLY), F.trunc("date", "month")).alias("g_date")) \
        .agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def _charts(sets: DataFrame, cells: DataFrame, index: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """set_id, _o, point of every chart."""
    def of(name: str) -> DataFrame:
        return cells.where(F.col("query_type") == name)

    key = ["set_id"]
    month = F.col("g_date").cast("timestamp_ntz")
    spines = F.element_at(B._month_spines(as_of, RANGES), F.col("period"))
    # users without an account that the filter admits have no points at all
    spine = index.where(F.col("query_type").isin(MONTHLY)).select("set_id", "query_type", "period", "categories").dropDuplicates(key) \
        .select("set_id", "query_type", "categories", F.explode(spines).alias("month"))
    parts = [widget_points("spending_by_category", of("spending_by_category").select(
        "set_id", label("g_category", "Uncategorized").alias("name"), money("value").alias("value")), key)]
    best = B.top_per(of("top_merchants"), key, [F.col("value").desc(), F.col("g_description").asc_nulls_last()], 2**31 - 1) \
        .where(F.col("rank") <= F.col("limit"))
    parts.append(widget_points("top_merchants", best.select(
        "set_id", "rank", label("g_description", "Unknown").alias("name"), money("value").alias("value"),
        F.col("n").alias("transactions")), key))
    parts.append(widget_points("daily_spending", of("daily_spending").select(
        "set_id", F.col("g_date").alias("date"), fmt_day("g_date").alias("name"), money("value").alias("value")), key))
    trend = of("monthly_trend").select("set_id", month.alias("month"), "value").groupBy("set_id", "month").agg(F.sum("value").alias("value"))
    parts.append(widget_points("monthly_trend", spine.where("query_type = 'monthly_trend'").join(trend, ["set_id", "month"], "left").select(
        "set_id", "month", fmt_month("month").alias("name"), money(F.coalesce("value", F.lit(0))).alias("value")), key))
    both = of("monthly_income_expenses").groupBy("set_id", month.alias("month")).agg(
        F.sum(F.when(F.col("type") == "deposit", F.col("value"))).alias("inc"), F.sum(F.when(F.col("type") == "payment", F.col("value"))).alias("exp"))
    parts.append(widget_points("monthly_income_expenses", spine.where("query_type = 'monthly_income_expenses'")
                               .join(both, ["set_id", "month"], "left").select(
        "set_id", "month", fmt_month("month").alias("name"), money(F.coalesce("inc", F.lit(0))).alias("income"),
        money(F.coalesce("exp", F.lit(0))).alias("expenses")), key))
    # category_trend: the given categories, else the best of the period; a null one takes a slot and is dropped
    grid = spine.where("query_type = 'category_trend'")
    totals = of("category_trend").where(F.col("in_period") & ~F.col("given")).groupBy("set_id", "g_category").agg(F.sum("value").alias("v"))
    top = B.top_per(totals, key, [F.col("v").desc(), F.col("g_category").asc_nulls_first()], TOP_CATEGORIES) \
        .where(F.nullif(F.col("g_category"), F.lit("")).isNotNull()).select("set_id", F.col("g_category").alias("category"))
    given = grid.select("set_id", F.explode("categories").alias("category")).distinct()
    spent = of("category_trend").groupBy("set_id", F.col("g_category").alias("category"), month.alias("month")).agg(F.sum("value").alias("v"))
    wide = grid.select("set_id", "month").join(top.unionByName(given), "set_id").join(spent, ["set_id", "category", "month"], "left") \
        .select("set_id", "month", "category", money(F.coalesce("v", F.lit(0))).alias("value"))
    parts.append(wide_points(wide, grid.select("set_id", "month"), key))
    held = sets.where(F.col("q.query_type") == "account_balances").join(acc, F.col("q.user_id") == acc["user_id"]) \
        .where(F.coalesce(F.col("q.account_type") == acc["account_type"], F.lit(True)))
    parts.append(widget_points("account_balances", held.select(
        "set_id", acc["account_id"], acc["name"], money("balance").alias("value"), acc["account_type"].alias("type")), key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _goals(sets: DataFrame, cells: DataFrame, acc: DataFrame) -> DataFrame:
    """set_id, point of every goal: one object each."""
    goals = sets.select(F.col("set_id").alias("goal_id"), "q.*")
    total = cells.where(F.col("query_type").isin(GOAL_QUERIES)).groupBy(F.col("set_id").alias("goal_id")).agg(F.sum("value").alias("_sum"))
    kinds = {"goal_savings_progress": "savings", "goal_debt_payoff_progress": "debt_payoff", "goal_spending_limit": "spending_limit"}
    typed = goals.withColumn("goal_type", F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("query_type")))
    results = [G.savings_progress(typed, acc, total), G.goal_debt(typed, acc),
               G.limit_progress(typed.where("goal_type = 'spending_limit'").join(total, "goal_id", "left"), F.coalesce("_sum", F.lit(0)))]
    out = None
    for r in results:
        points = r.select(F.col("goal_id").alias("set_id"), F.to_json(F.struct(*[c for c in r.columns if c not in ("goal_id", "user_id")])).alias("point"))
        out = points if out is None else out.unionByName(points)
    return out


def query_data(sets: DataFrame, tx: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """V7: set_id, data (JSON) and n_points of every filter set (set_id, q) that has any.

    Charts give an array of objects, goals one object.  Unknown query types give nothing.
    """
    sets = sets.checkpoint()
    index = admitted(sets, acc, as_of).checkpoint()
    cells = sums(daily_base(tx, as_of), index).checkpoint()      # written once; every chart and goal sums it up
    charts = _charts(sets, cells, index, acc, as_of).groupBy("set_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "point"))), lambda x: x["point"]).alias("points"))
    lists = charts.select("set_id", F.concat(F.lit("["), F.array_join("points", ","), F.lit("]")).alias("data"),
                          F.size("points").cast("bigint").alias("n_points"))
    return lists.unionByName(_goals(sets, cells, acc).select("set_id", F.col("point").alias("data"), F.lit(1).cast("bigint").alias("n_points")))


def refresh_widgets(widgets: DataFrame, tx: DataFrame, acc: DataFrame, as_of: datetime) -> DataFrame:
    """The data of every dynamic widget computed anew and written into its config.

    Every widget gets a row with its status: ``refreshed``, ``static`` (not a
    dynamic one) or ``no_query`` (dynamic, but without a configuration); the last
    two keep their config.  Without a column query_config the columns query_type
    and time_range are the configuration.
    """
    if "query_config" not in widgets.columns:
        widgets = widgets.withColumn("query_config", F.to_json(F.struct("query_type", "time_range")))
    dynamic = F.coalesce(F.col("data_mode") == "dynamic", F.lit(False))
    asked = requests(widgets.select("widget_id", "user_id", "data_mode", "query_config", "config")) \
        .withColumn("status", F.when(~dynamic, "static").when(F.col("q.query_type").isNull(), "no_query").otherwise("refreshed"))
    sets = asked.where("status = 'refreshed'").select("set_id", "q").dropDuplicates(["set_id"])
    done = asked.join(query_data(sets, tx, acc, as_of), "set_id", "left")
    new = F.col("status") == "refreshed"
    return done.select(
        "widget_id", "user_id", F.col("q.query_type").alias("query_type"), F.col("q.period").alias("time_range"), "status",
        F.when(new, F.coalesce("n_points", F.lit(0))).cast("bigint").alias("n_points"),
        F.when(new, set_widget_json(F.col("config"), F.coalesce("data", F.lit("[]")))).otherwise(F.col("config")).alias("config"),
        F.when(new, F.lit(as_of).cast("timestamp_ntz")).alias("last_refreshed"))
