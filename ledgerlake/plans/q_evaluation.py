"""Registered evaluation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.common import ts_lit
from ..operators import evaluation as EV
from ..sources import fixtures as X
from .registry import register

# A previous evaluation run saw every pair that ended before this time.
PREVIOUS_RUN = datetime(2024, 1, 3)

PAIRS_SQL = """select q.trace_id as agent_trace_id, q.session_id, q.user_id, q.agent_id, q.content as user_question,
  a.content as agent_answer, q.turn_number, a.tool_name as invoked_tool_name, a.response_time_ms, a.model_name,
  a.total_tokens, a.completion_tokens, a.prompt_tokens, q.trace_end
from (select *, row_number() over (partition by session_id order by trace_end, trace_id, routing_step, message_id) as turn_number
      from (select trace_id, session_id, user_id, cast(null as bigint) as agent_id, message_type, content,
              cast(null as varchar) as tool_name, response_time_ms, cast(null as varchar) as model_name, total_tokens,
              cast(null as integer) as completion_tokens, cast(null as integer) as prompt_tokens, trace_end,
              routing_step, message_id
            from chat_history where message_type in ('human', 'ai')) m) q
join (select *, row_number() over (partition by session_id order by trace_end, trace_id, routing_step, message_id) as turn_number
      from (select trace_id, session_id, message_type, content, cast(null as varchar) as tool_name, response_time_ms,
              cast(null as varchar) as model_name, total_tokens, cast(null as integer) as completion_tokens,
              cast(null as integer) as prompt_tokens, trace_end, routing_step, message_id
            from chat_history where message_type in ('human', 'ai')) m) a
  on q.trace_id = a.trace_id and q.session_id = a.session_id
where q.message_type = 'human' and a.message_type = 'ai' and q.content is not null and a.content is not null"""


def _band(x: str) -> str:
    return f"cast(1.0 + floor(least(greatest({x}, 0.0), 1.0) * 4) as float)"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r]+'), lambda x: x <> '')"


METRIC_SQL = {
    "intent_resolution": "cast(case when length(agent_answer) < 20 then 2.0 when length(agent_answer) < 100 then 3.0 "
                         "when length(agent_answer) < 400 then 4.0 else 5.0 end as float)",
    "relevance": _band("cast(len(list_intersect(list_distinct(qw), list_distinct(aw))) as double) / greatest(len(list_distinct(qw)), 1)"),
    "coherence": _band("cast(len(list_distinct(aw)) as double) / greatest(len(aw), 1)"),
    "fluency": _band("1.0 - abs(cast(coalesce(list_sum(list_transform(aw, lambda w: length(w))), 0) as double) "
                     "/ greatest(len(aw), 1) - 5.0) / 5.0"),
}


def _scores_select() -> str:
    empty = "(coalesce(length(trim(user_question)), 0) = 0 or coalesce(length(trim(agent_answer)), 0) = 0)"
    cols = []
    for m, expr in METRIC_SQL.items():
        v = f"(case when not {empty} then {expr} end)"
        cols += [f"{v} as {m}",
                 f"case when not {empty} then concat('offline {m} score ', cast(cast({v} as integer) as varchar)) "
                 f"else '' end as {m}_reason",
                 f"case when {empty} then '' when {v} >= 3.0 then 'pass' else 'fail' end as {m}_result",
                 f"case when not {empty} then cast(3.0 as float) end as {m}_threshold"]
    cols.append(f"case when {empty} then 'Empty question or answer' end as evaluation_error")
    return ",\n  ".join(cols)


SCORES_SQL = f"""select p.*, {_scores_select()}
from (select *, {_words('user_question')} as qw, {_words('agent_answer')} as aw from pairs) p"""

SCORE_OUT = ["agent_trace_id", "session_id", "turn_number", "response_time_ms"] + EV.SCORE_FIELDS
CTES = [("pairs", PAIRS_SQL), ("scores", SCORES_SQL)]


def _pairs(spark, d):
    return EV.qa_pairs(X.chat_history(spark, d))


def _scores(spark, d):
    return EV.flatten_scores(EV.score_pairs(_pairs(spark, d)), run_id="r1")


@register("j2_qa_pairs", "select * from pairs", ctes=[("pairs", PAIRS_SQL)])
def j2(spark, d):
    return _pairs(spark, d)


@register("j3_qa_with_history", """
select c.agent_trace_id, c.session_id, c.turn_number, count(p.turn_number) as n_prior,
  coalesce(string_agg(cast(p.turn_number as varchar), ',' order by p.turn_number), '') as prior_turns,
  md5(coalesce(string_agg(p.user_question || chr(9) || p.agent_answer, chr(10)
    order by p.turn_number, p.user_question, p.agent_answer), '')) as history_md5
from pairs c left join pairs p on p.session_id = c.session_id and c.turn_number > p.turn_number
group by c.agent_trace_id, c.session_id, c.turn_number, c.user_question, c.agent_answer""", ctes=[("pairs", PAIRS_SQL)])
def j3(spark, d):
    h = EV.qa_with_history(_pairs(spark, d))
    told = F.transform("conversation_history", lambda x: F.concat(x["question"], F.lit("\t"), x["answer"]))
    return h.select("agent_trace_id", "session_id", "turn_number",
                    F.size("conversation_history").cast("bigint").alias("n_prior"),
                    F.array_join(F.transform("conversation_history", lambda x: x["turn"].cast("string")), ",")
                    .alias("prior_turns"), F.md5(F.array_join(told, "\n")).alias("history_md5"))


@register("f11_to_messages", """
select c.agent_trace_id, c.session_id, c.turn_number, 2 * count(p.turn_number) + 2 as n_messages,
  md5(coalesce(string_agg('user:' || p.user_question || chr(10) || 'assistant:' || p.agent_answer || chr(10), ''
    order by p.turn_number, p.user_question, p.agent_answer), '')
    || 'user:' || c.user_question || chr(10) || 'assistant:' || c.agent_answer || chr(10)) as messages_md5
from pairs c left join pairs p on p.session_id = c.session_id and c.turn_number > p.turn_number
group by c.agent_trace_id, c.session_id, c.turn_number, c.user_question, c.agent_answer""", ctes=[("pairs", PAIRS_SQL)])
def f11(spark, d):
    h = EV.qa_with_history(_pairs(spark, d))
    msgs = EV.to_messages(F.col("conversation_history"), F.col("user_question"), F.col("agent_answer"))
    line = F.transform("msgs", lambda m: F.concat(m["role"], F.lit(":"), m["content"], F.lit("\n")))
    return h.withColumn("msgs", msgs).select(
        "agent_trace_id", "session_id", "turn_number", F.size("msgs").cast("bigint").alias("n_messages"),
        F.md5(F.array_join(line, "")).alias("messages_md5"))


@register("j4_new_pairs", f"""
select p.agent_trace_id, p.session_id, p.turn_number from pairs p
where not exists (select 1 from pairs s where s.trace_end < timestamp '{PREVIOUS_RUN}' and s.agent_trace_id = p.agent_trace_id)""",
          ctes=[("pairs", PAIRS_SQL)])
def j4(spark, d):
    pairs = _pairs(spark, d)
    previous = pairs.filter(F.col("trace_end") < ts_lit(PREVIOUS_RUN))
    return EV.new_pairs(pairs, previous).select("agent_trace_id", "session_id", "turn_number")


@register("u2_evaluated_ids", "select distinct agent_trace_id from scores", ctes=CTES)
def u2(spark, d):
    return EV.evaluated_ids(_scores(spark, d))


@register("v1_score_pairs", f"select {', '.join(SCORE_OUT)} from scores", ctes=CTES)
def v1(spark, d):
    return _scores(spark, d).select(*SCORE_OUT)


@register("a27_eval_overall", """
select count(*) as total_evaluations, round(avg(cast(intent_resolution as double)), 6) as avg_intent_resolution,
  round(avg(cast(relevance as double)), 6) as avg_relevance, round(avg(cast(coherence as double)), 6) as avg_coherence,
  round(avg(cast(fluency as double)), 6) as avg_fluency, round(avg(cast(response_time_ms as double)), 6) as avg_response_time_ms
from scores""", ctes=CTES)
def a27(spark, d):
    return EV.eval_overall(_scores(spark, d))


@register("a28_eval_by_turn_type", """
select case when turn_number = 1 then 'First Turn' else 'Follow-up' end as turn_type, count(*) as count,
  round(avg(cast(intent_resolution as double)), 6) as avg_intent_resolution, round(avg(cast(relevance as double)), 6) as avg_relevance,
  round(avg(cast(coherence as double)), 6) as avg_coherence, round(avg(cast(fluency as double)), 6) as avg_fluency
from scores group by 1""", ctes=CTES)
def a28(spark, d):
    return EV.eval_by_turn_type(_scores(spark, d))


@register("a29_eval_distribution", "\nunion all\n".join(
    f"select '{m}' as metric, cast({m} as double) as score, count(*) as count from scores where {m} is not null group by 2"
    for m in EV.METRICS), ctes=CTES)
def a29(spark, d):
    return EV.eval_distribution(_scores(spark, d))


@register("a30_eval_quality", "select " + ", ".join(
    [f"count(case when {m} is null then 1 end) as null_{m}" for m in EV.METRICS]
    + ["count(case when evaluation_error is not null then 1 end) as errors"]) + " from scores", ctes=CTES)
def a30(spark, d):
    return EV.eval_quality(_scores(spark, d))


@register("a31_eval_describe", "\nunion all\n".join(
    f"select '{m}' as metric, count({m}) as count, round(avg(cast({m} as double)), 6) as mean, "
    f"round(stddev_samp(cast({m} as double)), 6) as stddev, min(cast({m} as double)) as min, "
    f"max(cast({m} as double)) as max from scores" for m in EV.METRICS), ctes=CTES)
def a31(spark, d):
    return EV.eval_describe(_scores(spark, d))
