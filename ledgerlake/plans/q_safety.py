"""Registered content-safety queries (F3, F7, P11, R3-R9, R12, S16) and streaming checks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import safety as S
from ..session import checkpoint_path
from ..sources import fixtures as X
from ..sources.tables import read_table, stream_table
from ..streaming import events as SE
from ..streaming import sessions as RS
from .oracle import sql_iso
from .registry import register

EV_AS_OF = X.TIMED_AS_OF - timedelta(days=1)   # last event day


def _ev(spark, d):
    return X.agentic_events(spark, d)


@register("r3_events_by_category", """
select timestamp as DateTime, filter_category, count(*) as eventCount from agentic_events group by 1, 2""")
def r3(spark, d):
    return S.events_by_category(_ev(spark, d))


@register("r4_allowed_events", """
select timestamp as DateTime, count(*) as eventCount from agentic_events
where starts_with(lower(filter_category), 'none') group by 1""")
def r4(spark, d):
    return S.allowed_events(_ev(spark, d))


@register("r5_blocked_events", """
select timestamp as DateTime, filter_category, count(*) as eventCount from agentic_events
where not contains(lower(filter_category), 'none') group by 1, 2""")
def r5(spark, d):
    return S.blocked_events(_ev(spark, d))


@register("r6_category_series", """
select c.category, e.timestamp as DateTime, count(*) as eventCount
from agentic_events e join (select unnest(['self_harm', 'violence', 'sexual', 'jailbreak', 'hate']) as category) c
  on starts_with(lower(e.filter_category), c.category)
group by 1, 2""")
def r6(spark, d):
    return S.all_category_series(_ev(spark, d))


@register("r6b_violence_series", """
select timestamp as DateTime, count(*) as eventCount from agentic_events
where starts_with(lower(filter_category), 'violence') group by 1""")
def r6b(spark, d):
    return S.category_series(_ev(spark, d), "violence")


@register("r7_recent_events", f"""
select trace_id, timestamp, filter_category from agentic_events
where timestamp > timestamp '{EV_AS_OF - timedelta(hours=1)}' and timestamp <= timestamp '{EV_AS_OF}'""")
def r7(spark, d):
    return S.recent(_ev(spark, d), EV_AS_OF).select("trace_id", "timestamp", "filter_category")


@register("r8_retain_events", f"""
select trace_id, timestamp, filter_category from agentic_events
where timestamp > timestamp '{EV_AS_OF - timedelta(days=1)}' and timestamp <= timestamp '{EV_AS_OF}'""")
def r8(spark, d):
    return S.retain(_ev(spark, d), EV_AS_OF).select("trace_id", "timestamp", "filter_category")


def _jv(path: str) -> str:
    v = f"json_extract_string(content_filter_results, '{path}')"
    return f"case when starts_with({v}, '{{') or starts_with({v}, '[') then null else {v} end"


ISSUE_COLS = ",\n  ".join(f"{_jv(f'$.{c}.{f}')} as {c}_{f}" for c, f in S.ISSUE_PATHS)
FLAG = " or ".join([f"coalesce({c}_{f} = 'true', false)" for c, f in S.ISSUE_PATHS if f in ("filtered", "detected")]
                   + [f"coalesce({c}_{f} <> 'safe', false)" for c, f in S.ISSUE_PATHS if f == "severity"])


@register("r9_content_issues", f"""
select *, ({FLAG}) as is_issue from (
select session_id, trace_id, user_id, cast(null as bigint) as agent_id, message_type, content, content_filter_results,
  {ISSUE_COLS}
from chat_history where message_type = 'ai') v""")
def r9(spark, d):
    return S.content_issues(X.chat_history(spark, d))


def _error_text(cat_col):
    return F.when(F.lower(cat_col) == "none", F.lit("Error code: 200 - ok")).otherwise(F.concat(
        F.lit("Error code: 400 - The response was filtered due to the prompt triggering content management policy. "
              "{'inner_error': {'content_filter_results': {'"), F.lower(cat_col),
        F.lit("': {'filtered': True, 'severity': 'high'}}}}")))


ERR_SQL = ("case when lower(filter_category) = 'none' then 'Error code: 200 - ok' else "
           "'Error code: 400 - The response was filtered due to the prompt triggering content management policy. "
           "{''inner_error'': {''content_filter_results'': {''' || lower(filter_category) || "
           "''': {''filtered'': True, ''severity'': ''high''}}}}' end")


def _hit(c: str) -> str:
    return (f"(contains(err, 'The response was filtered') and contains(err, '''{c}'': {{''filtered'': True'))")


def _doc_sql() -> str:
    parts = []
    for c in S.CATEGORIES:
        h = _hit(c)
        if c == "jailbreak":
            parts.append(f"'\"{c}\":{{\"filtered\":' || case when {h} then 'true' else 'false' end || "
                         f"',\"detected\":' || case when {h} then 'true' else 'false' end || '}}'")
        else:
            parts.append(f"'\"{c}\":{{\"filtered\":' || case when {h} then 'true' else 'false' end || "
                         f"',\"severity\":\"' || case when {h} then 'high' else 'safe' end || '\"}}'")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _cat_sql() -> str:
    expr = "'unknown'"
    for c in S.CATEGORIES:
        expr = f"case when {_hit(c)} then '{c}' else {expr} end"
    return expr


@register("f7_safety_category", f"""
select trace_id, {_cat_sql()} as filter_category, {_doc_sql()} as content_filter_results
from (select trace_id, {ERR_SQL} as err from agentic_events) e""")
def f7(spark, d):
    ev = _ev(spark, d)
    return ev.select("trace_id", S.safety_category(_error_text(F.col("filter_category"))).alias("s")) \
        .select("trace_id", "s.*")


@register("r12_violations_to_rows", """
select trace_id, user_id as session_id, user_id, filter_category, r.target, r.message_type, r.routing_step, r.content, r.from_agent,
  r.current_agent
from (select *, unnest([
    {'target': 'chat_history', 'message_type': 'ai', 'routing_step': 1, 'content': message, 'from_agent': null::varchar,
     'current_agent': null::varchar},
    {'target': 'agent_traces', 'message_type': null::varchar, 'routing_step': 1, 'content': null::varchar,
     'from_agent': 'system', 'current_agent': null::varchar}]) as r
  from agentic_events where not contains(lower(filter_category), 'none')) x""")
def r12(spark, d):
    ev = _ev(spark, d).withColumn("session_id", F.col("user_id")) \
        .withColumn("user_message", F.lit(None).cast("string")).withColumn("agent_name", F.lit(None).cast("string"))
    return S.violations_to_rows(ev)


@register("s16_trace_to_events", f"""
select a.trace_id, a.routing_step,
  json_object('timestamp', {sql_iso("a.trace_end")}, 'trace_id', a.trace_id, 'session_id', a.session_id,
    'user_id', a.user_id, 'message', a.content, 'agent_name', a.agent_name, 'user_message', q.user_message,
    'filter_category', 'None', 'content_filter_info', '{S.NOT_BLOCKED}')::varchar as event
from chat_history a
left join (select trace_id, arg_min(content, routing_step) as user_message from chat_history
           where message_type = 'human' group by trace_id) q on q.trace_id = a.trace_id
where a.message_type = 'ai'""")
def s16(spark, d):
    return S.trace_to_events(X.chat_history(spark, d))


@register("r3s_events_by_category_stream", """
select time_bucket(interval 1 minute, timestamp) as window_start,
  time_bucket(interval 1 minute, timestamp) + interval 1 minute as window_end, filter_category, count(*) as eventCount
from agentic_events group by 1, 2, 3""")
def r3s(spark, d):
    """Runs the real streaming job (file source, watermark, window) to completion."""
    stream = SE.read_events_stream(spark, d)
    out = SE.run_to_table(SE.events_by_category_windowed(stream), mode="complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "filter_category", "eventCount")


FIRST_SEEN = [
    ("seen", "select session_id, agent_name, trace_end, trace_id, routing_step, row_number() over (partition by session_id, agent_name "
             "order by trace_end, trace_id, routing_step) as r from chat_history where agent_name is not null"),
    ("used", "select session_id, string_agg(agent_name, ',' order by trace_end, trace_id, routing_step) as names, count(*) as n "
             "from seen where r = 1 group by session_id")]


@register("r10_session_state_stream", """
select c.session_id, coalesce(any_value(u.names), '') as agent_names_used, coalesce(any_value(u.n), 0) as total_agents_used,
  count(*) as n_messages, cast(floor((epoch_us(max(trace_end)) - epoch_us(min(trace_end))) / 1000) as bigint) as session_duration_ms,
  cast(date_diff('second', min(trace_end), max(trace_end)) as bigint) as sess_duration
from chat_history c left join used u on u.session_id = c.session_id group by c.session_id""", ctes=FIRST_SEEN)
def r10(spark, d):
    """Running state of all sessions, kept by a stateful stream over the conversations read as a file stream."""
    conv = stream_table(spark, d, "conversations", read_table(spark, d, "conversations").schema)
    path = checkpoint_path(spark, f"sessions-{uuid.uuid4().hex}")
    RS.run_sessions(X.chat_messages(conv), path).awaitTermination()
    return RS.sessions_table(spark, path).read().select(
        "session_id", "agent_names_used", "total_agents_used", "n_messages", "session_duration_ms", "sess_duration")
