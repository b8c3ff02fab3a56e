"""Domain tables derived from the driver's parquet (mapping in FIXTURES.md).

The reference ships no data, so its banking and telemetry tables are derived
from the test tables with arithmetic only.  Every function here is a plain
DataFrame transformation of the raw scan, so its cost grows with the input and
Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import read_table

# Fixed values of the mapping (FIXTURES.md part 2).
BANK_AS_OF = datetime(2001, 8, 1)       # last order date
TIMED_AS_OF = datetime(2024, 1, 31)     # day after the last event
CHAT_EPOCH = "2024-01-01 00:00:00"


def _user_of(custkey: Column) -> Column:
    return F.floor(custkey / 3).cast("bigint")


def users(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return (c.groupBy(_user_of(F.col("c_custkey")).alias("user_id"))
             .agg(F.min("c_name").alias("name"), F.min("c_nationkey").alias("nation")))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("account_id"),
        _user_of(F.col("c_custkey")).alias("user_id"),
        F.when(F.col("c_acctbal") < 0, "credit")
         .when(F.col("c_custkey") % 3 == 0, "checking")
         .otherwise("savings").alias("account_type"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("balance"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 3).cast("string")).alias("name"),
    )


def transactions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    n_customers = read_table(spark, d, "customer").select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey") % 5
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 3, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("from_account_id"),
        F.when(k == 3, F.col("o_custkey"))
         .when(k == 4, (F.col("o_custkey") + 1) % n_customers).alias("to_account_id"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("amount"),
        F.when(k < 3, "payment").when(k == 3, "deposit").otherwise("transfer").alias("type"),
        F.concat(F.lit("Payment to Merchant "), (F.col("o_orderkey") % 25).cast("string")).alias("description"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def timed_transactions(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), "user_id",
        F.col("value").cast("decimal(15,2)").alias("amount"),
        F.lit("completed").alias("status"),
        F.col("event_type").alias("description"),
        F.col("ts").alias("created_at"),
    )


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    conv = read_table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = conv.withColumn("ask", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("bigint"))
    ct = F.col("conv_id") + F.col("turn")
    is_ai = F.col("role") == "assistant"

    def flag(mod: int) -> Column:
        return F.when(ct % mod == 0, "true").otherwise("false")

    cfr = F.concat(
        F.lit('{"hate":{"filtered":'), flag(11), F.lit(',"severity":"'),
        F.when(ct % 11 == 0, "high").otherwise("safe"), F.lit('"},"jailbreak":{"filtered":'),
        flag(13), F.lit(',"detected":'), flag(13), F.lit("}}"),
    )
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("session_id"),
        (F.col("conv_id") * 100 + F.floor((F.col("ask") + 1) / 2).cast("bigint")).alias("trace_id"),
        (F.col("conv_id") % 50).alias("user_id"),
        F.col("turn").alias("routing_step"),
        F.when(F.col("role") == "user", "human").when(is_ai, "ai").otherwise("system").alias("message_type"),
        F.col("text").alias("content"),
        F.when(is_ai, F.when(ct % 3 == 0, "account_agent").when(ct % 3 == 1, "support_agent")
               .otherwise("visualization_agent")).alias("agent_name"),
        F.when(is_ai, ((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 5000).cast("int")).alias("response_time_ms"),
        F.when(is_ai, (F.length("text") % 997).cast("int")).alias("total_tokens"),
        F.when(is_ai, cfr).alias("content_filter_results"),
        (F.lit(CHAT_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(hours=F.col("conv_id").cast("int"))
         + F.make_dt_interval(secs=F.col("turn") * 30)).alias("trace_end"),
    )


def chat_messages(conv: DataFrame) -> DataFrame:
    """What the running session state needs of chat_history, row by row (no window, so it works on a stream).

    A message's trace is numbered by its turn instead of the asks before it: both grow together.
    """
    ct = F.col("conv_id") + F.col("turn")
    return conv.select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("trace_id"), F.col("turn").cast("bigint").alias("routing_step"),
        F.when(F.col("role") == "assistant", F.when(ct % 3 == 0, "account_agent").when(ct % 3 == 1, "support_agent")
               .otherwise("visualization_agent")).alias("agent_name"),
        (F.lit(CHAT_EPOCH).cast("timestamp") + F.make_dt_interval(hours=F.col("conv_id").cast("int"))
         + F.make_dt_interval(secs=F.col("turn") * 30)).alias("trace_end"))


def agent_traces(spark: SparkSession, d: str, ch: DataFrame | None = None) -> DataFrame:
    ch = chat_history(spark, d) if ch is None else ch
    ai = ch.filter(F.col("message_type") == "ai")
    w_sess = Window.partitionBy("session_id").orderBy("routing_step")
    w_trace = Window.partitionBy("trace_id").orderBy("routing_step")
    return ai.select(
        F.col("message_id").alias("trace_step_id"), "session_id", "trace_id", "user_id",
        F.coalesce(F.lag("agent_name").over(w_sess), F.lit("system")).alias("from_agent"),
        F.col("agent_name").alias("current_agent"),
        F.row_number().over(w_trace).cast("int").alias("step_order"),
        F.col("response_time_ms").alias("execution_duration_ms"),
    )


def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("tool_call_id"), F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tool_name"), F.col("props").alias("tool_input"),
        F.when(F.col("event_type") == "error", F.lit('{"message":"Error: tool failed"}'))
         .otherwise(F.lit('{"message":"ok"}')).alias("tool_output"),
        (F.col("event_id") % 500).cast("int").alias("tokens_used"),
    )


def agentic_events(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    et = F.col("event_type")
    return e.select(
        F.col("ts").alias("timestamp"), F.col("event_id").alias("trace_id"), "user_id",
        F.when(et == "signup", "jailbreak").when(et == "purchase", "Violence")
         .when(et == "error", "self_harm").otherwise("None").alias("filter_category"),
        F.col("props").alias("message"),
    )


def chunk_source(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.col("source").alias("source_pdf"), "text")


# Tables the mapping leaves implicit, derived the same way (oracle twins in
# ledgerlake.plans.oracle).

def chat_sessions(spark: SparkSession, d: str, ch: DataFrame | None = None) -> DataFrame:
    """One session per conversation: first / last message time, owner."""
    ch = chat_history(spark, d) if ch is None else ch
    return (ch.groupBy("session_id")
              .agg(F.min("user_id").alias("user_id"),
                   F.min("trace_end").alias("created_at"),
                   F.max("trace_end").alias("updated_at")))


def goals(spark: SparkSession, d: str) -> DataFrame:
    """One goal per account: savings -> savings goal, credit -> debt payoff,
    checking -> spending limit.  Targets are arithmetic on the balance."""
    a = accounts(spark, d)
    bal = F.col("balance")
    return a.select(
        F.col("account_id").alias("goal_id"), "user_id",
        F.when(F.col("account_type") == "savings", "savings")
         .when(F.col("account_type") == "credit", "debt_payoff").otherwise("spending_limit").alias("goal_type"),
        F.when(F.col("account_id") % 2 == 0, F.col("name")).alias("linked_account_name"),
        (F.abs(bal) * 2).cast("decimal(15,2)").alias("target_amount"),
        (F.abs(bal) * 3).cast("decimal(15,2)").alias("original_debt"),
        (F.abs(bal) + 100).cast("decimal(15,2)").alias("spending_limit"),
        F.when(F.col("account_id") % 4 == 1, "1-URGENT").when(F.col("account_id") % 4 == 3, "2-HIGH").alias("category"),
        F.date_add(F.lit(BANK_AS_OF.date()), (F.col("account_id") % 400).cast("int") - 100).alias("deadline"),
    )


# Scenario tables for the projection jobs (X1-X5): arithmetic on customer keys
# and balances, one scenario per customer, including the edge cases (rate 0,
# no contribution, no monthly saving, over-allocated budgets).

def _cust(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer")


def loans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _cust(spark, d).select(
        k.alias("loan_id"), (10000 + (k % 50) * 5000).cast("double").alias("principal"),
        F.when(k % 37 == 0, F.lit(0.0)).otherwise((k % 8).cast("double") + 1.5).alias("annual_rate"),
        F.when(k % 4 == 0, 10).when(k % 4 == 1, 15).when(k % 4 == 2, 20).otherwise(30).alias("term_years"),
        ((k % 5) * 100).cast("double").alias("extra_payment"))


def savings_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _cust(spark, d).select(
        k.alias("plan_id"), F.abs("c_acctbal").alias("initial_deposit"),
        ((k % 10) * 100).cast("double").alias("monthly_contribution"),
        (k % 9).cast("double").alias("annual_return"), (5 + k % 26).cast("int").alias("years"))


def budget_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _cust(spark, d).select(
        k.alias("plan_id"), (3000 + (k % 40) * 100).cast("double").alias("income"),
        (20 + k % 20).cast("int").alias("housing"), (5 + k % 15).cast("int").alias("transportation"),
        (5 + k % 12).cast("int").alias("food"), (5 + k % 25).cast("int").alias("savings"))


def retirement_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _cust(spark, d).select(
        k.alias("plan_id"), (25 + k % 30).cast("int").alias("current_age"), F.lit(65).alias("retirement_age"),
        (F.abs("c_acctbal") * 10).alias("current_savings"),
        (200 + (k % 9) * 100).cast("double").alias("monthly_contribution"),
        (3 + k % 6).cast("double").alias("expected_return"))


def emergency_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _cust(spark, d).select(
        k.alias("plan_id"), (2000 + (k % 30) * 100).cast("double").alias("monthly_expenses"),
        (3 + k % 4).cast("int").alias("target_months"), F.abs("c_acctbal").alias("current_savings"),
        ((k % 6) * 100).cast("double").alias("monthly_savings"))


# Widget kinds created per user (7 chart queries, 5 simulations)
# and the time ranges cycled through.
WIDGET_KINDS = ["spending_by_category", "monthly_trend", "monthly_income_expenses", "account_balances",
                "top_merchants", "daily_spending", "category_trend",
                "loan_repayment", "savings_projector", "budget_planner", "retirement_calculator", "emergency_fund"]
WIDGET_RANGES = ["last_6_months", "this_year", "last_3_months", "all_time"]


def ai_widgets(spark: SparkSession, d: str) -> DataFrame:
    """One widget per (user, kind); every third chart is static; configs hold an empty data list."""
    u = users(spark, d)
    rows = u.select("user_id", F.posexplode(F.array(*[F.lit(k) for k in WIDGET_KINDS])).alias("j", "query_type"))
    is_sim = F.col("j") >= 7
    cfg = F.concat(F.lit('{"title":"'), F.col("query_type"), F.lit(' widget","chartType":"bar",'
                                                                  '"customProps":{"colors":["#3B82F6"],"data":[]}}'))
    return rows.select(
        (F.col("user_id") * 100 + F.col("j")).alias("widget_id"), "user_id",
        F.when(is_sim, "simulation").otherwise("chart").alias("widget_type"),
        F.when(is_sim | ((F.col("user_id") + F.col("j")) % 3 == 0), "static").otherwise("dynamic").alias("data_mode"),
        "query_type",
        F.element_at(F.array(*[F.lit(r) for r in WIDGET_RANGES]), ((F.col("user_id") + F.col("j")) % 4 + 1).cast("int"))
         .alias("time_range"),
        cfg.alias("config"),
        (F.lit("2001-07-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(hours=((F.col("user_id") * 7 + F.col("j") * 13) % 500).cast("int"))).alias("updated_at"),
    )


# Fixed value: the time ranges of the filtered widgets, the last one unknown.
QUERY_RANGES = ["last_6_months", "this_year", "last_3_months", "all_time", "last_30_days", "this_month", "some_day"]


def widget_queries(spark: SparkSession, d: str) -> DataFrame:
    """Charts and goals with filters: one widget per user and chart query, one per goal."""
    u, j = F.col("user_id"), F.col("j")
    charts = users(spark, d).select("user_id", F.posexplode(F.array(*[F.lit(k) for k in WIDGET_KINDS[:7]])).alias("j", "query_type"))
    none = F.lit(None)
    charts = charts.select(
        (u * 100 + j).alias("widget_id"), "user_id", "query_type", (u + j).alias("k"),
        F.when((u + j) % 4 == 1, u * 3 + 1).alias("account_id"), F.when(u % 2 == 0, "savings").alias("account_type"),
        F.when((u + j) % 3 == 1, F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT"))).alias("categories"),
        F.when((u + j) % 2 == 0, 3).alias("limit"), none.cast("string").alias("category"), none.cast("decimal(15,2)").alias("target_amount"),
        none.cast("decimal(15,2)").alias("original_debt"), none.cast("decimal(15,2)").alias("spending_limit"),
        none.cast("string").alias("linked_account_name"))
    kind = F.when(F.col("goal_type") == "savings", "goal_savings_progress").when(
        F.col("goal_type") == "debt_payoff", "goal_debt_payoff_progress").otherwise("goal_spending_limit")
    of_goals = goals(spark, d).select(
        (10_000_000 + F.col("goal_id")).alias("widget_id"), "user_id", kind.alias("query_type"), F.col("goal_id").alias("k"),
        F.when(F.col("goal_id") % 7 == 0, F.col("goal_id")).alias("account_id"), none.cast("string").alias("account_type"),
        none.cast("array<string>").alias("categories"), none.cast("int").alias("limit"), "category", "target_amount", "original_debt",
        "spending_limit", "linked_account_name")
    w = charts.unionByName(of_goals)
    filters = ["account_id", "account_type", "categories", "limit", "category", "target_amount", "original_debt", "spending_limit",
               "linked_account_name"]
    k = F.col("k")
    period = F.element_at(F.array(*[F.lit(r) for r in QUERY_RANGES]), (k % 7 + 1).cast("int"))
    return w.select("widget_id", "user_id", F.when(k % 5 == 0, "static").otherwise("dynamic").alias("data_mode"),
                    F.to_json(F.struct("query_type", period.alias("time_range"), F.struct(*filters).alias("filters"))).alias("query_config"),
                    F.lit('{"title":"w","customProps":{"height":30}}').alias("config"))
