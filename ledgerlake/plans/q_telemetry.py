"""Registered telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import route
from ..operators import telemetry as T
from ..sources import fixtures as X
from ..sources.tables import read_table
from .registry import register


def _ch(spark, d):
    return X.chat_history(spark, d)


@register("p10_conversation_messages", """
select trace_id, session_id, user_id, cast(null as bigint) as agent_id, message_type, content, cast(null as varchar) as tool_name,
  response_time_ms, cast(null as varchar) as model_name, total_tokens, cast(null as integer) as completion_tokens,
  cast(null as integer) as prompt_tokens, trace_end, routing_step, message_id
from chat_history where message_type in ('human', 'ai')""")
def p10(spark, d):
    return T.conversation_messages(_ch(spark, d))


@register("w1_turn_number", """
select session_id, message_id, row_number() over (partition by session_id order by trace_end, trace_id, routing_step, message_id)
  as turn_number
from chat_history where message_type in ('human', 'ai')""")
def w1(spark, d):
    return T.turn_number(T.conversation_messages(_ch(spark, d))).select("session_id", "message_id", "turn_number")


@register("w2_agent_hops", """
select session_id, trace_id, user_id, message_id,
  cast(row_number() over (partition by trace_id order by routing_step, message_id) as integer) as step_order,
  lag(agent_name, 1, 'system') over (partition by trace_id order by routing_step, message_id) as from_agent,
  agent_name as current_agent, response_time_ms as execution_duration_ms
from chat_history where message_type = 'ai'""")
def w2(spark, d):
    return T.agent_hops(_ch(spark, d).filter(F.col("message_type") == "ai"))


REPLAY = """(select message_id, trace_id, routing_step from chat_history
  union all select message_id, trace_id, routing_step + 100 from chat_history where message_type = 'human')"""


@register("w3_dedupe_messages", f"""
select message_id, trace_id, routing_step from (
  select *, row_number() over (partition by trace_id, message_id order by routing_step) as r from {REPLAY} x) y where r = 1""")
def w3(spark, d):
    ch = _ch(spark, d).select("message_id", "trace_id", "routing_step", "message_type")
    replay = ch.unionByName(ch.filter(F.col("message_type") == "human").withColumn("routing_step", F.col("routing_step") + 100))
    return T.dedupe_messages(replay.drop("message_type"))


UPSERTS = """(select tool_call_id, tool_output, tokens_used, 1 as logged_at from tool_usage
  union all select tool_call_id, '{"message":"Error: retried"}' as tool_output, tokens_used + 1 as tokens_used, 2 as logged_at
  from tool_usage where tool_name = 'click')"""


@register("w4_latest_tool_usage", f"""
select tool_call_id, arg_max(tool_output, logged_at) as tool_output, arg_max(tokens_used, logged_at) as tokens_used,
  max(logged_at) as logged_at
from {UPSERTS} u group by tool_call_id""")
def w4(spark, d):
    tu = X.tool_usage(spark, d).select("tool_call_id", "tool_output", "tokens_used", "tool_name")
    v1 = tu.select("tool_call_id", "tool_output", "tokens_used", F.lit(1).alias("logged_at"))
    v2 = tu.filter(F.col("tool_name") == "click").select(
        "tool_call_id", F.lit('{"message":"Error: retried"}').alias("tool_output"),
        (F.col("tokens_used") + 1).alias("tokens_used"), F.lit(2).alias("logged_at"))
    return T.latest_tool_usage(v1.unionByName(v2), "logged_at")


@register("j1_user_asks", """
select ch1.user_id, ch1.trace_id, ch1.content, ch1.session_id, ch2.response_time_seconds, ch1.date
from (select user_id, trace_id, content, session_id, cast(trace_end as date) as date from chat_history
      where message_type = 'human') ch1
join (select trace_id, case when response_time_ms is not null then response_time_ms / 1000.0 end as response_time_seconds
      from chat_history) ch2 on ch1.trace_id = ch2.trace_id
where ch2.response_time_seconds is not null""")
def j1(spark, d):
    return T.user_asks(_ch(spark, d))


@register("j7_attach_ids", """
select c.message_id, c.agent_name, a.agent_id
from chat_history c left join (select agent_name as name, min(message_id) as agent_id from chat_history
  where agent_name is not null group by agent_name) a on c.agent_name = a.name""")
def j7(spark, d):
    ch = _ch(spark, d)
    return T.attach_ids(ch, T.agent_definitions(ch)).select("message_id", "agent_name", "agent_id")


@register("j9_build_tool_usage", """
select cast(event_id as varchar) as tool_call_id, user_id as session_id, event_id as trace_id, event_type as tool_name,
  props as tool_input,
  case when event_type = 'error' then '{"message":"Error: tool failed"}' else '{"message":"ok"}' end as tool_output,
  case when event_type = 'error' then 'Error: tool failed' else 'ok' end as tool_message,
  case when event_type = 'error' then 'Errored' else 'Healthy' end as status,
  'account_agent' as executing_agent, cast(event_id % 500 as integer) as tokens_used
from events""")
def j9(spark, d):
    return T.build_tool_usage(T.tool_messages(read_table(spark, d, "events")))


@register("a23_trace_summary", """
select t.current_agent as agent, count(t.trace_step_id) as total_steps,
  round(coalesce(avg(cast(t.execution_duration_ms as double)), 0.0), 2) as avg_duration_ms,
  cast(coalesce(sum(c.total_tokens), 0) as bigint) as total_tokens, count(distinct t.session_id) as unique_sessions
from agent_traces t left join chat_history c on c.message_id = t.trace_step_id
group by t.current_agent""")
def a23(spark, d):
    ch = _ch(spark, d)
    return T.trace_summary(X.agent_traces(spark, d, ch), ch)


@register("a24_session_traces", """
select session_id, trace_id, count(*) as n_steps,
  string_agg(current_agent, '>' order by step_order, trace_step_id) as agent_path
from agent_traces group by session_id, trace_id""")
def a24(spark, d):
    return T.session_traces(X.agent_traces(spark, d)).drop("steps")


@register("a25_session_stats", """
select s.session_id, s.user_id, coalesce(a.names, '') as agent_names_used, coalesce(a.n, 0) as total_agents_used,
  cast(floor((epoch_us(s.updated_at) - epoch_us(s.created_at)) / 1000) as bigint) as session_duration_ms
from chat_sessions s left join (
  select session_id, string_agg(current_agent, ',' order by trace_id, step_order) as names, count(*) as n
  from (select session_id, current_agent, trace_id, step_order,
          row_number() over (partition by session_id, current_agent order by trace_id, step_order) as r
        from agent_traces) f where r = 1 group by session_id) a on a.session_id = s.session_id""")
def a25(spark, d):
    ch = _ch(spark, d)
    return T.session_stats(X.agent_traces(spark, d, ch), X.chat_sessions(spark, d, ch))


@register("a26_session_duration", """
select user_id, session_id, cast(created_at as date) as date,
  cast(epoch(date_trunc('second', updated_at)) - epoch(date_trunc('second', created_at)) as bigint) as sess_duration
from chat_sessions""")
def a26(spark, d):
    return T.session_duration(X.chat_sessions(spark, d))


TOOL_DEFS = """(select tool_name as name, min(tool_call_id) as tool_id, length(tool_name) % 2 = 0 as is_active,
  cast(length(tool_name) as integer) as cost_per_call_cents from tool_usage group by tool_name)"""


@register("p12_active_tools", f"""select name, tool_id, is_active, cost_per_call_cents from {TOOL_DEFS} td where is_active""")
def p12(spark, d):
    return T.active_tools(T.tool_definitions(X.tool_usage(spark, d)))


@register("a39_usage_kpis", f"""
select 'total_sessions' as metric, cast(count(*) as double) as value from (select session_id from chat_history group by 1) s
union all select 'total_messages', cast(count(*) as double) from chat_history
union all select 'avg_session_length', round(avg(cast(n as double)), 4) from (select count(*) as n from chat_history group by session_id) s
union all select 'total_tool_calls', cast(count(*) as double) from tool_usage
union all select 'error_rate', round(avg(case when contains(lower(coalesce(tool_output, '')), 'error') then 1.0 else 0.0 end), 6)
  from tool_usage
union all select 'total_cost_cents', cast(coalesce(sum(td.cost_per_call_cents), 0) as double)
  from tool_usage u left join {TOOL_DEFS} td on td.name = u.tool_name""")
def a39(spark, d):
    tu = X.tool_usage(spark, d)
    return T.usage_kpis(_ch(spark, d), tu, T.tool_definitions(tu))


@register("a39b_tool_stats", f"""
select u.tool_name, count(*) as calls,
  cast(sum(case when contains(lower(coalesce(u.tool_output, '')), 'error') then 1 else 0 end) as bigint) as errors,
  cast(sum(u.tokens_used) as bigint) as tokens, cast(count(*) * min(td.cost_per_call_cents) as bigint) as cost_cents
from tool_usage u left join {TOOL_DEFS} td on td.name = u.tool_name group by u.tool_name""")
def a39b(spark, d):
    tu = X.tool_usage(spark, d)
    return T.tool_stats(tu, T.tool_definitions(tu))


@register("t1_recent_history", """
select session_id, user_id, trace_id, message_type, content, trace_end, n - r + 1 as position
from (select *, row_number() over (partition by session_id order by trace_end desc, trace_id desc, routing_step desc,
        message_id desc) as r, count(*) over (partition by session_id) as n0 from chat_history) x
join (select session_id as s, least(count(*), 50) as n from chat_history group by 1) c on c.s = x.session_id
where r <= 50""")
def t1(spark, d):
    return T.recent_history(_ch(spark, d), 50)


@register("t2_rebuild_transcript", """
select session_id, trace_id, message_type, content,
  row_number() over (partition by session_id order by tf, trace_id,
    case message_type when 'human' then 1 when 'ai' then 2 else 5 end, trace_end, message_id) as position
from (select c.*, min(trace_end) over (partition by trace_id) as tf from chat_history c
      where message_type in ('human', 'ai')) x""")
def t2(spark, d):
    return T.rebuild_transcript(_ch(spark, d))


@register("t6_list_sessions", """
select user_id, session_id, updated_at, row_number() over (partition by user_id order by updated_at desc, session_id desc) as rank
from chat_sessions""")
def t6(spark, d):
    return T.list_sessions(X.chat_sessions(spark, d))


@register("p15_route", """
select message_id,
  case lower(agent_name) when 'visualization_agent' then 'visualization_agent' when 'account_agent' then 'account_agent'
    else 'support_agent' end as pass_to,
  case lower(agent_name) when 'visualization_agent' then 'visualization_management'
    when 'account_agent' then 'account_management' else 'customer_support' end as task_type
from chat_history where message_type = 'ai'""")
def p15(spark, d):
    ai = _ch(spark, d).filter(F.col("message_type") == "ai")
    return ai.select("message_id", route("agent_name").alias("r")).select("message_id", "r.*")
