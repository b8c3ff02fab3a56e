"""Registered queries for the building blocks the larger operators share
(S1-S6, S9, P1-P6, P11, P13, P16, P17, P20, J6, W5, T7, F2, F3, F8-F10, R1, R2, R11, R14)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.common import (fmt_day, fmt_iso, fmt_minute, fmt_month, in_period, label, largest_period, money,
                                ms_to_s, signed_amount, sql_ts, summary_period, time_range, ts_lit)
from ..functions.text import chunk, join_context
from ..operators import banking as B
from ..operators import documents as D
from ..operators import evaluation as EV
from ..operators import safety as S
from ..session import checkpoint_path
from ..sources import fixtures as X
from ..sources import io as IO
from ..sources.tables import RAW_TABLES, read_path_or_empty, read_table, register_all
from ..streaming import events as SE
from .q_evaluation import CTES as SCORE_CTES
from .q_evaluation import PAIRS_SQL, PREVIOUS_RUN, SCORE_OUT
from .q_safety import _jv
from .registry import register

AS_OF = X.BANK_AS_OF
EITHER = ("(select distinct t.*, a.user_id from transactions t join accounts a "
          "on a.account_id = t.from_account_id or a.account_id = t.to_account_id)")


def _scratch(spark, name: str) -> str:
    """A fresh table folder under the shared checkpoint folder."""
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- sources and sinks

@register("s1_read_transactions", "select * from transactions")
def s1(spark, d):
    return X.transactions(spark, d)


@register("s2_read_chat_history", "select * from chat_history")
def s2(spark, d):
    return X.chat_history(spark, d)


@register("s3_read_widgets", "select * from ai_widgets")
def s3(spark, d):
    return X.ai_widgets(spark, d)


COUNTS_SQL = "\nunion all\n".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in RAW_TABLES)


@register("s4_register_all", COUNTS_SQL)
def s4(spark, d):
    register_all(spark, d)
    return spark.sql(COUNTS_SQL)


@register("s5_read_or_empty", "select agent_trace_id, session_id, turn_number from pairs", ctes=[("pairs", PAIRS_SQL)])
def s5(spark, d):
    """First run: the scores table does not exist yet, so every pair is new."""
    pairs = EV.qa_pairs(X.chat_history(spark, d))
    scores = read_path_or_empty(spark, _scratch(spark, "scores"), EV._scores_schema(pairs))
    return EV.new_pairs(pairs, scores).select("agent_trace_id", "session_id", "turn_number")


@register("s6_append", f"select {', '.join(SCORE_OUT)} from scores", ctes=SCORE_CTES)
def s6(spark, d):
    path = _scratch(spark, "append")
    scores = EV.flatten_scores(EV.score_pairs(EV.qa_pairs(X.chat_history(spark, d))), "r1").select(*SCORE_OUT)
    IO.append(scores, path)
    return spark.read.parquet(path)


@register("s9_seed_if_empty", "select * from accounts")
def s9(spark, d):
    path = _scratch(spark, "seed")
    acc = X.accounts(spark, d)
    for _ in range(2):                      # the second call finds rows and writes nothing
        IO.seed_if_empty(acc, read_path_or_empty(spark, path, acc.schema), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- predicates and scoping

@register("p1_for_user", f"""
select id, user_id from {EITHER} e where user_id in (select user_id from users where nation = 0)""")
def p1(spark, d):
    ut = B.user_transactions(X.transactions(spark, d), X.accounts(spark, d))
    scope = X.users(spark, d).filter(F.col("nation") == 0).select("user_id")
    return B.for_user(ut, scope).select("id", "user_id")


def _range_counts(spark, d, bounds: dict[str, tuple[datetime, datetime]]):
    """Transactions per named period in one scan: each row explodes into the periods it falls in."""
    tx = X.transactions(spark, d)
    periods = F.array(*[F.struct(F.lit(n).alias("name"), ts_lit(s).alias("s"), ts_lit(e).alias("e"))
                        for n, (s, e) in bounds.items()])
    hits = tx.select("amount", F.explode(F.filter(periods, lambda p: F.col("created_at").between(p["s"], p["e"])))
                     .alias("p"))
    return hits.groupBy(F.col("p.name").alias("period"), F.col("p.s").alias("start")) \
        .agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total"))


def _range_sql(bounds: dict[str, tuple[datetime, datetime]]) -> str:
    return "\nunion all\n".join(
        f"select '{n}' as period, {sql_ts(s)} as start, count(*) as n, round(cast(sum(amount) as double), 2) as total "
        f"from transactions where created_at between {sql_ts(s)} and {sql_ts(e)} having count(*) > 0"
        for n, (s, e) in bounds.items())


RANGES = {n: time_range(n, AS_OF) for n in ["last_6_months", "last_3_months", "last_12_months", "last_year",
                                             "this_year", "this_month", "last_30_days", "last_7_days", "all_time",
                                             "unknown"]}
SUMMARY = {t: summary_period(t, AS_OF) for t in ["this month", "Last 6 Months please", "THIS YEAR", "whatever"]}
LARGEST = {n: largest_period(n, AS_OF) for n in ["this_month", "last_3_months", "last_6_months", "this_year",
                                                 "all time"]}


@register("p2_time_range", _range_sql(RANGES))
def p2(spark, d):
    return _range_counts(spark, d, RANGES)


@register("p3_summary_period", _range_sql(SUMMARY))
def p3(spark, d):
    return _range_counts(spark, d, SUMMARY)


@register("p4_largest_period", _range_sql(LARGEST))
def p4(spark, d):
    return _range_counts(spark, d, LARGEST)


S6M, E6M = RANGES["last_6_months"]


@register("p5_in_period", f"""
select id, created_at from transactions where created_at between {sql_ts(S6M)} and {sql_ts(E6M)}""")
def p5(spark, d):
    return X.transactions(spark, d).filter(in_period("created_at", S6M, E6M)).select("id", "created_at")


@register("p6_apply_filters", f"""
select a.user_id, coalesce(nullif(t.category, ''), 'Uncategorized') as name, round(cast(sum(t.amount) as double), 2) as value
from transactions t join accounts a on t.from_account_id = a.account_id
where t.type = 'payment' and t.created_at between {sql_ts(S6M)} and {sql_ts(E6M)}
  and t.category in ('1-URGENT', '2-HIGH') and a.account_type = 'savings'
group by a.user_id, t.category""")
def p6(spark, d):
    return B.spending_by_category(X.transactions(spark, d), X.accounts(spark, d), AS_OF, "last_6_months",
                                  {"categories": ["1-URGENT", "2-HIGH"], "account_type": "savings"})


@register("p11_text_predicates", """
select filter_category,
  count(*) filter (where starts_with(lower(filter_category), 'none')) as n_startswith_none,
  count(*) filter (where contains(lower(filter_category), 'lence')) as n_contains_lence,
  count(*) filter (where not contains(lower(filter_category), 'none')) as n_not_contains_none
from agentic_events group by filter_category""")
def p11(spark, d):
    ev = X.agentic_events(spark, d)
    return ev.groupBy("filter_category").agg(
        F.count_if(S.ci_startswith("filter_category", "None")).alias("n_startswith_none"),
        F.count_if(S.ci_contains("filter_category", "LENCE")).alias("n_contains_lence"),
        F.count_if(S.ci_not_contains("filter_category", "None")).alias("n_not_contains_none"))


@register("p13_label", """
select id, coalesce(nullif(category, ''), 'Uncategorized') as category_label,
  coalesce(nullif(description, ''), 'Unknown') as description_label from transactions""")
def p13(spark, d):
    tx = X.transactions(spark, d)
    return tx.select("id", label("category", "Uncategorized").alias("category_label"),
                     label("description", "Unknown").alias("description_label"))


@register("p16_ms_to_s", """
select message_id, response_time_ms / 1000.0 as response_time_seconds from chat_history""")
def p16(spark, d):
    return X.chat_history(spark, d).select("message_id", ms_to_s("response_time_ms").alias("response_time_seconds"))


@register("p17_signed_amount", f"""
select user_id, round(cast(sum(case when type = 'payment' then -amount else amount end) as double), 2) as net
from {EITHER} e group by user_id""")
def p17(spark, d):
    ut = B.user_transactions(X.transactions(spark, d), X.accounts(spark, d))
    return ut.groupBy("user_id").agg(money(F.sum(signed_amount())).alias("net"))


@register("p20_flatten_scores", f"""
select {', '.join(SCORE_OUT)}, 'r1' as evaluation_run_id, '{EV.METHOD}' as evaluation_method from scores""",
          ctes=SCORE_CTES)
def p20(spark, d):
    s = EV.flatten_scores(EV.score_pairs(EV.qa_pairs(X.chat_history(spark, d))), "r1")
    return s.select(*SCORE_OUT, "evaluation_run_id", "evaluation_method")


# ---------------------------------------------------------------- joins, ranking, top-k

@register("j6_user_scope", """
select t.id, a.user_id, t.type from transactions t join accounts a on t.to_account_id = a.account_id""")
def j6(spark, d):
    return B.user_scope(X.transactions(spark, d), X.accounts(spark, d), "to").select("id", "user_id", "type")


@register("w5_top_per", """
select account_id, rank, id, round(cast(amount as double), 2) as amount from (
  select from_account_id as account_id, id, amount,
    row_number() over (partition by from_account_id order by amount desc, id) as rank
  from transactions where from_account_id is not null) r where rank <= 3""")
def w5(spark, d):
    tx = X.transactions(spark, d).filter(F.col("from_account_id").isNotNull()) \
        .withColumnRenamed("from_account_id", "account_id")
    top = B.top_per(tx, ["account_id"], [F.col("amount").desc(), F.col("id").asc()], 3)
    return top.select("account_id", "rank", "id", money("amount").alias("amount"))


@register("t7_topn", """
select id, round(cast(amount as double), 2) as amount from transactions order by amount desc, id limit 5""")
def t7(spark, d):
    top = B.topn(X.transactions(spark, d), 5, [F.col("amount").desc(), F.col("id").asc()])
    return top.select("id", money("amount").alias("amount"))


# ---------------------------------------------------------------- scalar functions

@register("f2_chunk", """
select doc_id, chunk_no, substring(text, cast(chunk_no * 400 + 1 as integer), 500) as chunk_text
from (select doc_id, text, unnest(generate_series(0, cast(ceil(length(text) / 400.0) as bigint) - 1)) as chunk_no
      from documents where length(text) > 0) x""")
def f2(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk("text", 500, 100)).alias("chunk_no", "chunk_text")) \
        .withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@register("f3_filter_fields", "select message_id, " + ", ".join(
    f"{_jv(f'$.{c}.{f}')} as {c}_{f}" for c, f in S.ISSUE_PATHS) + " from chat_history")
def f3(spark, d):
    return X.chat_history(spark, d).select("message_id", *S.filter_fields("content_filter_results"))


@register("f8_formats", """
select event_id,
  case when date_part('microseconds', ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S')
       else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as iso,
  strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%d %H:%M') as minute, strftime(ts, '%b %Y') as month
from events""")
def f8(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", fmt_iso("ts").alias("iso"), fmt_day("ts").alias("day"),
                    fmt_minute("ts").alias("minute"), fmt_month("ts").alias("month"))


@register("f9_money", """
select o_orderkey, round(cast(cast(o_totalprice as decimal(15,2)) as double), 2) as amount from orders""")
def f9(spark, d):
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", money(F.col("o_totalprice").cast("decimal(15,2)")).alias("amount"))


SEP_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@register("f10_join_context", f"""
select doc_id, string_agg(chunk_text, {SEP_SQL} order by chunk_no) as context from chunks group by doc_id""",
          ctes=[("chunks", __import__("ledgerlake.plans.q_text", fromlist=["CHUNKS_SQL"]).CHUNKS_SQL)])
def f10(spark, d):
    ch = D.chunk_documents(X.chunk_source(spark, d))
    g = ch.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_text"))).alias("c"))
    return g.select("doc_id", join_context(F.transform("c", lambda x: x["chunk_text"])).alias("context"))


# ---------------------------------------------------------------- streaming sources, sinks, state

AGENTIC_OUT = """select trace_id, timestamp, user_id, filter_category, message from agentic_events"""


def _agentic_cols(df):
    return df.select("trace_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "user_id",
                     "filter_category", "message")


@register("r1_read_events_stream", AGENTIC_OUT)
def r1(spark, d):
    return _agentic_cols(SE.run_to_table(SE.read_events_stream(spark, d), mode="append"))


@register("r2_land_events", AGENTIC_OUT)
def r2(spark, d):
    path = _scratch(spark, "landed")
    SE.land_events(SE.read_events_stream(spark, d), path).awaitTermination()
    return _agentic_cols(spark.read.parquet(path))


@register("r11_upsert_tool_usage", """
select tool_call_id, arg_max(tool_output, logged_at) as tool_output, arg_max(tokens_used, logged_at) as tokens_used
from (select tool_call_id, tool_output, tokens_used, 1 as logged_at from tool_usage
      union all select tool_call_id, '{"message":"Error: retried"}', tokens_used + 1, 2 from tool_usage
      where tool_name = 'click') u group by tool_call_id""")
def r11(spark, d):
    tu = X.tool_usage(spark, d)
    src = _scratch(spark, "tool-updates")
    t1 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    t2 = F.lit("2024-01-01 01:00:00").cast("timestamp")
    schema = "tool_call_id bigint, tool_output string, tokens_used int, logged_at timestamp"
    log = _scratch(spark, "tool-log")

    def run(rows, name):
        rows.write.parquet(f"{src}/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        SE.upsert_tool_usage(stream, log).awaitTermination()

    run(tu.select("tool_call_id", "tool_output", "tokens_used", t1.alias("logged_at")), "b1")
    SE.tool_usage_table(spark, log).compact()                # what follows is read from the snapshot and one newer delta
    run(tu.filter(F.col("tool_name") == "click").select(
        "tool_call_id", F.lit('{"message":"Error: retried"}').alias("tool_output"),
        (F.col("tokens_used") + 1).alias("tokens_used"), t2.alias("logged_at")), "b2")
    return SE.current_tool_usage(spark, log).select("tool_call_id", "tool_output", "tokens_used")


@register("r14_score_increment", f"select {', '.join(SCORE_OUT)} from scores", ctes=SCORE_CTES)
def r14(spark, d):
    """A previous run scored the early pairs; the stream scores only the rest; every pair ends up once."""
    pairs = EV.qa_pairs(X.chat_history(spark, d))
    scores = _scratch(spark, "scores")
    EV.score_increment(pairs.filter(F.col("trace_end") < ts_lit(PREVIOUS_RUN)), scores, "r0")
    src = _scratch(spark, "pairs")
    pairs.write.parquet(src)
    SE.score_increment_stream(spark.readStream.schema(pairs.schema).parquet(src), scores).awaitTermination()
    return spark.read.parquet(scores).select(*SCORE_OUT)
