"""Registered star-schema, widget, JSON, trace fan-out and table-maintenance queries
(J10, A32, V7, J11, P14, P19, F4, F5, F6, R13, S10-S15, S17, S18, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import canonical_tool
from ..functions.json import decode_at, decode_json, decode_json_deep
from ..operators import star as ST
from ..operators import telemetry as T
from ..operators import widgets as W
from ..sources import fixtures as X
from ..sources import io as IO
from ..sources.tables import read_table
from .oracle import sql_iso
from .registry import register

AS_OF = X.BANK_AS_OF


def _star_tables(spark, d):
    return {"transactions": X.transactions(spark, d), "accounts": X.accounts(spark, d), "users": X.users(spark, d)}


@register("j10_star_transactions", """
select t.id, cast(t.amount as double) as amount, a.account_type as accounts__account_type, u.name as users__name,
  u.nation as users__nation, f.account_type as from_account__account_type
from transactions t left join accounts a on a.account_id = t.to_account_id
left join users u on u.user_id = a.user_id
left join accounts f on f.account_id = t.from_account_id""")
def j10(spark, d):
    star = ST.star_view(_star_tables(spark, d), "transactions", {"transactions.from_account_id": "from_account"})
    return star.select("id", F.col("amount").cast("double").alias("amount"), "accounts__account_type", "users__name",
                       "users__nation", "from_account__account_type")


@register("a32_measure_amount", """
select a.account_type as accounts__account_type, t.status, round(cast(sum(t.amount) as double), 2) as sum_amount
from transactions t left join accounts a on a.account_id = t.to_account_id
group by 1, 2""")
def a32(spark, d):
    star = ST.star_view(_star_tables(spark, d), "transactions")
    m = ST.measure(star, "amount", ["accounts__account_type", "status"])
    return m.withColumn("sum_amount", F.round(F.col("sum_amount").cast("double"), 2))


@register("a32b_measure_balance", """
select u.nation as users__nation, round(cast(sum(a.balance) as double), 2) as sum_balance
from accounts a left join users u on u.user_id = a.user_id group by 1""")
def a32b(spark, d):
    t = _star_tables(spark, d)
    star = ST.star_view({"accounts": t["accounts"], "users": t["users"]}, "accounts")
    m = ST.measure(star, "balance", ["users__nation"])
    return m.withColumn("sum_balance", F.round(F.col("sum_balance").cast("double"), 2))


@register("a32c_measure_tokens", """
select s.user_id as chat_sessions__user_id, cast(sum(c.total_tokens) as bigint) as sum_total_tokens
from chat_history c left join chat_sessions s on s.session_id = c.session_id group by 1""")
def a32c(spark, d):
    ch = X.chat_history(spark, d)
    star = ST.star_view({"chat_history": ch, "chat_sessions": X.chat_sessions(spark, d, ch)}, "chat_history")
    m = ST.measure(star, "total_tokens", ["chat_sessions__user_id"])
    return m.withColumn("sum_total_tokens", F.col("sum_total_tokens").cast("bigint"))


_TOTALS = [("accounts", "balance"), ("transactions", "amount"), ("chat_history", "total_tokens"), ("tool_usage", "tokens_used"),
           ("agent_traces", "execution_duration_ms"), ("agent_traces", "step_order")]


@register("a32d_sum_measures", " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, round(cast(sum({c}) as double), 2) as total from {t}" for t, c in _TOTALS)
    + """ union all select 'session_duration_date', 'sess_duration', cast(sum(cast(epoch(date_trunc('second', updated_at))
  - epoch(date_trunc('second', created_at)) as bigint)) as double) from chat_sessions""")
def a32d(spark, d):
    ch = X.chat_history(spark, d)
    tables = {"accounts": X.accounts(spark, d), "transactions": X.transactions(spark, d), "chat_history": ch,
              "tool_usage": X.tool_usage(spark, d), "agent_traces": X.agent_traces(spark, d, ch),
              "session_duration_date": T.session_duration(X.chat_sessions(spark, d, ch))}
    return ST.totals(tables).withColumn("total", F.round("total", 2))


@register("p19_widget_counts", """
select user_id, count(*) as all_widgets, count(*) filter (where widget_type <> 'simulation') as charts,
  count(*) filter (where widget_type = 'simulation') as simulations
from ai_widgets group by user_id""")
def p19(spark, d):
    return W.widget_counts(X.ai_widgets(spark, d))


@register("t6b_list_widgets", """
select user_id, widget_id, updated_at,
  row_number() over (partition by user_id order by updated_at desc, widget_id desc) as rank from ai_widgets""")
def t6b(spark, d):
    return W.list_widgets(X.ai_widgets(spark, d))


# Members that a refresh must leave alone, inserted into the stored config.
F6_EXTRA = '"xAxisKey":"name","n":null,"nested":{"quote":"a\\"b","list":[1,2.5,true]},'


@register("f6_set_widget_data", f"""
select widget_id, config->>'$.title' as title, config->>'$.chartType' as chart_type, config->>'$.customProps.colors' as colors,
  config->>'$.customProps.data' as data, config->>'$.customProps.height' as height, config->>'$.xAxisKey' as x_axis,
  config->>'$.nested.quote' as quote, config->>'$.nested.list' as list
from (select widget_id, replace(replace(config, '{{"title"', '{{{F6_EXTRA}"title"'), '"data":[]',
        '"height":30,"data":[{{"widget":' || cast(widget_id as varchar) || '}}]') as config from ai_widgets) d""")
def f6(spark, d):
    # the list of users is short, and what is made of each takes long: it is dealt to all tasks
    w = X.ai_widgets(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "widget_id")
    stored = F.replace(F.replace(F.col("config"), F.lit('{"title"'), F.lit("{" + F6_EXTRA + '"title"')),
                       F.lit('"data":[]'), F.lit('"height":30,"data":[]'))
    point = F.concat(F.lit('{"widget":'), F.col("widget_id").cast("string"), F.lit("}"))
    done = w.select("widget_id", W.set_widget_data(stored, F.array(point)).alias("c"))
    paths = {"title": "$.title", "chart_type": "$.chartType", "colors": "$.customProps.colors", "data": "$.customProps.data",
             "height": "$.customProps.height", "x_axis": "$.xAxisKey", "quote": "$.nested.quote", "list": "$.nested.list"}
    return done.select("widget_id", *[F.get_json_object("c", p).alias(n) for n, p in paths.items()])


@register("v7_run_query", None)
def v7(spark, d):
    """The dispatcher over every chart query type, as one long table of points."""
    tx, acc = X.transactions(spark, d), X.accounts(spark, d)
    out = None
    for name in W.CHART_QUERIES:
        pts = W.widget_points(name, W.run_query(name, tx, acc, AS_OF)).select(
            F.lit(name).alias("query_type"), "user_id", "point")
        out = pts if out is None else out.unionByName(pts)
    return out


# ---------------------------------------------------------------- JSON and trace fan-out

ALIAS_TOOLS = {"click": "get_user_accounts_for_current_user", "view": "transfer_money_for_current_user"}


def _aliased_tool(col):
    return F.when(col == "click", ALIAS_TOOLS["click"]).when(col == "view", ALIAS_TOOLS["view"]).otherwise(col)


@register("p14_canonical_tool", """
select event_id, case event_type when 'click' then 'get_user_accounts' when 'view' then 'transfer_money'
  else event_type end as tool_name from events""")
def p14(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", canonical_tool(_aliased_tool(F.col("event_type"))).alias("tool_name"))


@register("f5_decode_json", """
select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events""")
def f5(spark, d):
    e = read_table(spark, d, "events")
    wrapped = F.to_json(F.struct("event_type", F.col("props").alias("payload")))   # JSON text inside JSON
    v = decode_json(wrapped)
    return e.select("event_id", F.variant_get(v, "$.event_type", "string").alias("event_type"),
                    F.variant_get(decode_at(v, "$.payload"), "$.k", "bigint").alias("k"))


@register("f5b_decode_json_deep", """
select event_id, '{"event_type":"' || event_type || '","payload":' || cast(json(props) as varchar) || '}' as decoded
from events""")
def f5b(spark, d):
    """Every JSON string inside the document decoded, at any depth (vectorised UDF, one Arrow batch per call)."""
    e = read_table(spark, d, "events")
    wrapped = F.to_json(F.struct("event_type", F.col("props").alias("payload")))
    return e.select("event_id", decode_json_deep(wrapped).alias("decoded"))


def raw_traces(spark, d):
    """Raw agent traces rebuilt from chat_history: per trace, one step per ai message; the first
    step also carries the trace's last question."""
    from pyspark.sql.window import Window
    ch = X.chat_history(spark, d)
    msg = F.struct(F.lit("AIMessage").alias("__class__"), F.col("message_id").cast("string").alias("id"),
                   F.col("content").alias("content"),
                   F.struct(F.lit("stop").alias("finish_reason"),
                            F.struct(F.col("total_tokens").cast("bigint").alias("total_tokens")).alias("token_usage"))
                   .alias("response_metadata"))
    ai = ch.filter(F.col("message_type") == "ai").withColumn(
        "step", F.row_number().over(Window.partitionBy("trace_id").orderBy("routing_step", "message_id")))
    q = ch.filter(F.col("message_type") == "human").groupBy(F.col("trace_id").alias("_t")).agg(
        F.max_by(F.struct(F.lit("HumanMessage").alias("__class__"), F.col("message_id").cast("string").alias("id"),
                          F.col("content").alias("content"),
                          F.lit(None).cast("struct<finish_reason:string,token_usage:struct<total_tokens:bigint>>")
                          .alias("response_metadata")), "routing_step").alias("q"))
    j = ai.join(q, ai["trace_id"] == q["_t"], "left")
    step_msgs = F.when((F.col("step") == 1) & F.col("q").isNotNull(), F.array(F.col("q"), msg)).otherwise(F.array(msg))
    steps = j.groupBy("trace_id", "session_id", "user_id").agg(F.array_sort(F.collect_list(F.struct(
        "step", F.col("agent_name").alias("node"), (F.col("response_time_ms") / 1000.0).alias("t"),
        F.to_json(step_msgs).alias("m")))).alias("s"))
    return steps.select("trace_id", "session_id", "user_id",
                        F.transform("s", lambda x: x["node"]).alias("nodes_list"),
                        F.transform("s", lambda x: x["t"]).alias("event_times"),
                        F.transform("s", lambda x: x["m"]).alias("messages"))


R13_SQL = """
select message_id, trace_id, session_id, message_type, routing_step, agent_name, total_tokens, response_time_ms
from (select message_id, trace_id, session_id, 'human' as message_type, 0 as routing_step, cast(null as varchar) as agent_name,
        cast(null as integer) as total_tokens, cast(null as integer) as response_time_ms,
        row_number() over (partition by trace_id order by routing_step desc) as r
      from chat_history where message_type = 'human'
        and trace_id in (select trace_id from chat_history where message_type = 'ai')) h where r = 1
union all
select message_id, trace_id, session_id, 'ai', cast(row_number() over (partition by trace_id order by routing_step, message_id) as integer),
  agent_name, total_tokens, response_time_ms
from chat_history where message_type = 'ai'"""


@register("r13_explode_trace", R13_SQL)
def r13(spark, d):
    out = T.explode_trace(raw_traces(spark, d))["chat_history"]
    return out.select(F.col("message_id").cast("bigint").alias("message_id"), "trace_id", "session_id", "message_type",
                      F.col("routing_step").cast("int").alias("routing_step"), "agent_name", "total_tokens",
                      "response_time_ms")


@register("r13s_explode_trace_stream", R13_SQL)
def r13s(spark, d):
    """The same fan-out as a Structured Streaming job over a folder of raw traces."""
    import uuid
    from ..session import checkpoint_path
    from ..streaming import events as SE
    raw = raw_traces(spark, d)
    src = checkpoint_path(spark, f"raw-traces-{uuid.uuid4().hex}")
    raw.write.parquet(src)
    out = checkpoint_path(spark, f"fan-out-{uuid.uuid4().hex}")
    SE.explode_trace_stream(spark.readStream.schema(raw.schema).parquet(src), out).awaitTermination()
    ch = spark.read.parquet(f"{out}/chat_history")
    return ch.select(F.col("message_id").cast("bigint").alias("message_id"), "trace_id", "session_id", "message_type",
                     F.col("routing_step").cast("int").alias("routing_step"), "agent_name", "total_tokens",
                     "response_time_ms")


@register("f4_message_fields", """
select message_id, cast(total_tokens as integer) as total_tokens, 'stop' as finish_reason
from chat_history where message_type = 'ai'""")
def f4(spark, d):
    out = T.explode_trace(raw_traces(spark, d))["chat_history"].filter(F.col("message_type") == "ai")
    return out.select(F.col("message_id").cast("bigint").alias("message_id"), "total_tokens", "finish_reason")


# ---------------------------------------------------------------- table maintenance and I/O

# The agents the reference seeds into agent_definitions.
SEED_AGENTS = ["account_agent", "transaction_agent", "support_agent"]


@register("s10_insert_missing", f"""
select name from (select agent_name as name from chat_history where agent_name is not null group by agent_name) t
union
select name from (select unnest([{", ".join(f"'{a}'" for a in SEED_AGENTS)}]) as name) s""")
def s10(spark, d):
    ch = X.chat_history(spark, d)
    existing = T.agent_definitions(ch)
    seed = spark.createDataFrame([(a,) for a in SEED_AGENTS], "name string")
    return IO.insert_missing(seed, existing, "name").select("name")


@register("s11_purge_sessions", """
select message_id from chat_history
where session_id not in (select session_id from chat_sessions where updated_at < timestamp '2024-01-02 00:00:00')""")
def s11(spark, d):
    ch = X.chat_history(spark, d)
    old = X.chat_sessions(spark, d, ch).filter(F.col("updated_at") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return IO.purge_sessions(ch, old).select("message_id")


@register("s12_with_empty_vector", """
select doc_id, source as source_pdf, cast(null as float[]) as embeddings from documents""")
def s12(spark, d):
    return IO.with_empty_vector(X.chunk_source(spark, d).select("doc_id", "source_pdf"))


@register("s13_describe_table", None)
def s13(spark, d):
    return IO.describe_table(spark, X.transactions(spark, d), "transactions")


@register("s14_guarded_sql", """
select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus""")
def s14(spark, d):
    read_table(spark, d, "orders").createOrReplaceTempView("orders")
    return IO.guarded_sql(spark, "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total "
                                 "from orders group by o_orderstatus", limit=5000)


@register("s15_to_json_rows", f"""
select json_object('id', id, 'from_account_id', from_account_id, 'to_account_id', to_account_id,
  'amount', cast(amount as varchar), 'type', type, 'description', description, 'category', category,
  'status', status, 'created_at', {sql_iso("created_at")})::varchar as json
from transactions""")
def s15(spark, d):
    return IO.to_json_rows(X.transactions(spark, d))


@register("s18_orphan_transactions", """
select id, 'from_account_id' as side, from_account_id as account_id from transactions
where from_account_id is not null and from_account_id not in (select account_id from accounts)
union all
select id, 'to_account_id', to_account_id from transactions
where to_account_id is not null and to_account_id not in (select account_id from accounts)""")
def s18(spark, d):
    return IO.orphan_transactions(X.transactions(spark, d), X.accounts(spark, d))
