"""Agent telemetry: sessions, routing hops, tool usage, transcripts (W1-W4, J1, J7, J9,
A23-A26, A39, T1, T2, T6, P10, P12).

Message tables are keyed by session and trace.  Statistics per trace or session
come from ``groupBy`` (map-side combine) joined back; ordered per-session
numbering uses windows, whose sort key always ends in a unique column (D1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import canonical_tool, ms_to_s

# Message types of the reference, and transcript priority.
MESSAGE_TYPES = ["human", "ai", "system", "tool_call", "tool_result"]
PRIORITY = {"human": 1, "ai": 2}
OTHER_PRIORITY = 5
# Columns of the conversation projection (P10).
CONVERSATION_COLUMNS = ["trace_id", "session_id", "user_id", "agent_id", "message_type", "content", "tool_name",
                        "response_time_ms", "model_name", "total_tokens", "completion_tokens", "prompt_tokens",
                        "trace_end"]
ORDER_KEYS = ["trace_end", "trace_id", "routing_step", "message_id"]  # D1 tie-break


def with_optional(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add absent reference columns as typed NULLs so projections stay stable."""
    types = {"agent_id": "bigint", "tool_name": "string", "model_name": "string", "completion_tokens": "int",
             "prompt_tokens": "int", "tool_call_id": "string"}
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return df


def conversation_messages(ch: DataFrame) -> DataFrame:
    """P10: human and ai messages, 13 columns (the reference's sort before a window is dropped)."""
    return with_optional(ch, CONVERSATION_COLUMNS).filter(F.col("message_type").isin("human", "ai")) \
        .select(*CONVERSATION_COLUMNS, "routing_step", "message_id")


def turn_number(msgs: DataFrame) -> DataFrame:
    """Order of each message within its session (D1 tie-break); a huge session stays distributed."""
    from .ordering import ordinal_within
    return ordinal_within(msgs, "session_id", ORDER_KEYS, "turn_number")


def agent_hops(steps: DataFrame, key: str = "trace_id") -> DataFrame:
    """Step order per trace and the hop chain (from_agent = previous agent, first = 'system').

    The previous step is found by an equi-join on (trace, step_order - 1)
    rather than ``lag`` over a per-trace window, so a very long trace is split
    by the range numbering and by AQE's skew-join handling instead of landing
    in one task.
    """
    from .ordering import ordinal_within
    numbered = ordinal_within(steps.select("session_id", "trace_id", "user_id", "message_id", "routing_step",
                                           "agent_name", "response_time_ms"),
                              key, ["routing_step", "message_id"], "_n")
    prev = numbered.select(F.col(key).alias("_k"), (F.col("_n") + 1).alias("_n"), F.col("agent_name").alias("_prev"))
    j = numbered.join(prev, (numbered[key] == prev["_k"]) & (numbered["_n"] == prev["_n"]), "left")
    return j.select("session_id", "trace_id", "user_id", "message_id",
                    numbered["_n"].cast("int").alias("step_order"),
                    F.when(numbered["_n"] == 1, F.lit("system")).otherwise(F.col("_prev")).alias("from_agent"),
                    F.col("agent_name").alias("current_agent"),
                    F.col("response_time_ms").alias("execution_duration_ms"))


def dedupe_messages(msgs: DataFrame) -> DataFrame:
    """Keep each message id once per trace (first routing step wins)."""
    w = Window.partitionBy("trace_id", "message_id").orderBy("routing_step")
    return msgs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``, the one with the largest ``order``; of different rows with equal ones always the same, by hash."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest, order), F.struct(F.col(order), F.xxhash64(*rest))).alias("_l"))
    return best.select(key, "_l.*")


def latest_tool_usage(tu: DataFrame, order_col: str = "logged_at") -> DataFrame:
    """One row per tool_call_id, the latest write wins (an upsert as an aggregate)."""
    return latest_by(tu, "tool_call_id", order_col)


def user_asks(ch: DataFrame) -> DataFrame:
    """UserAsks view: each human message joined to every timed message of its trace (D4 fan-out)."""
    q = ch.filter(F.col("message_type") == "human").select(
        "user_id", "trace_id", "content", "session_id", F.to_date("trace_end").alias("date"))
    a = ch.select(F.col("trace_id").alias("_t"), ms_to_s("response_time_ms").alias("response_time_seconds")) \
        .filter(F.col("response_time_seconds").isNotNull())
    return q.join(a, q["trace_id"] == a["_t"]).drop("_t")


def agent_definitions(ch: DataFrame) -> DataFrame:
    """Agent catalogue derived from the messages (id = first message id that used the name)."""
    return (ch.filter(F.col("agent_name").isNotNull())
              .groupBy(F.col("agent_name").alias("name")).agg(F.min("message_id").alias("agent_id")))


def attach_ids(msgs: DataFrame, agents: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Agent (and canonical tool) name -> id, NULL when unknown.

    The catalogues are tiny dimension tables; Spark broadcasts them by its
    size check (autoBroadcastJoinThreshold), no hint needed.
    """
    a = agents.select(F.col("name").alias("_an"), F.col("agent_id"))
    out = msgs.join(a, msgs["agent_name"] == a["_an"], "left").drop("_an")
    if tools is not None and "tool_name" in msgs.columns:
        t = tools.select(F.col("name").alias("_tn"), "tool_id")
        out = out.join(t, canonical_tool(out["tool_name"]) == t["_tn"], "left").drop("_tn")
    return out


def tool_messages(events: DataFrame) -> DataFrame:
    """Tool-call and tool-result message rows (two per call), shaped like chat_history."""
    call = events.select(F.col("event_id").cast("string").alias("tool_call_id"),
                         F.col("user_id").alias("session_id"), F.col("event_id").alias("trace_id"),
                         F.lit("tool_call").alias("message_type"), F.col("event_type").alias("tool_name"),
                         F.col("props").alias("tool_input"), F.lit(None).cast("string").alias("tool_output"),
                         F.lit("account_agent").alias("agent_name"), (F.col("event_id") % 500).cast("int").alias("total_tokens"))
    result = events.select(F.col("event_id").cast("string").alias("tool_call_id"),
                           F.col("user_id").alias("session_id"), F.col("event_id").alias("trace_id"),
                           F.lit("tool_result").alias("message_type"), F.col("event_type").alias("tool_name"),
                           F.lit(None).cast("string").alias("tool_input"),
                           F.when(F.col("event_type") == "error", F.lit('{"message":"Error: tool failed"}'))
                            .otherwise(F.lit('{"message":"ok"}')).alias("tool_output"),
                           F.lit("account_agent").alias("agent_name"), F.lit(None).cast("int").alias("total_tokens"))
    return call.unionByName(result)


def build_tool_usage(msgs: DataFrame) -> DataFrame:
    """Tool call joined to its result on tool_call_id -> one usage row.

    Status is the reference's substring test for "error" on the lowercased
    output (D17); the message is ``$.message`` of the output JSON.
    """
    calls = msgs.filter(F.col("message_type") == "tool_call").select(
        "tool_call_id", "session_id", "trace_id", "tool_name", "tool_input",
        F.col("agent_name").alias("executing_agent"), F.col("total_tokens").alias("tokens_used"))
    results = msgs.filter(F.col("message_type") == "tool_result").select(
        F.col("tool_call_id").alias("_id"), "tool_output")
    j = calls.join(results, calls["tool_call_id"] == results["_id"], "left").drop("_id")
    out = F.col("tool_output")
    return j.select("tool_call_id", "session_id", "trace_id", canonical_tool("tool_name").alias("tool_name"),
                    "tool_input", "tool_output",
                    F.coalesce(F.get_json_object(out, "$.message"), F.coalesce(out, F.lit(""))).alias("tool_message"),
                    F.when(F.lower(F.coalesce(out, F.lit("None"))).contains("error"), "Errored")
                     .otherwise("Healthy").alias("status"),
                    "executing_agent", "tokens_used")


def trace_summary(traces: DataFrame, ch: DataFrame, user_id=None, agent_name: str | None = None) -> DataFrame:
    """Per agent: steps, mean duration, tokens, distinct sessions (D3: grouped by current_agent)."""
    t = traces
    if user_id is not None:
        t = t.filter(F.col("user_id") == user_id)
    if agent_name:
        t = t.filter(F.col("current_agent") == agent_name)
    tok = ch.select(F.col("message_id").alias("trace_step_id"), F.col("total_tokens").alias("_tok"))
    j = t.join(tok, "trace_step_id", "left")
    return j.groupBy(F.col("current_agent").alias("agent")).agg(
        F.count("trace_step_id").alias("total_steps"),
        F.round(F.coalesce(F.avg(F.col("execution_duration_ms").cast("double")), F.lit(0.0)), 2).alias("avg_duration_ms"),
        F.coalesce(F.sum("_tok"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.countDistinct("session_id").alias("unique_sessions"))


def session_traces(traces: DataFrame) -> DataFrame:
    """Steps of each trace, ordered, as an array (plus the agent path)."""
    g = traces.groupBy("session_id", "trace_id").agg(
        F.array_sort(F.collect_list(F.struct("step_order", "trace_step_id", "from_agent", "current_agent",
                                             "execution_duration_ms"))).alias("steps"))
    return g.select("session_id", "trace_id", F.size("steps").cast("bigint").alias("n_steps"),
                    F.array_join(F.transform("steps", lambda s: s["current_agent"]), ">").alias("agent_path"), "steps")


def session_stats(traces: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct agents in first-seen order, their count and the session duration in ms."""
    first_seen = traces.groupBy("session_id", "current_agent").agg(
        F.min(F.struct("trace_id", "step_order")).alias("_first"))
    agents = first_seen.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("_first", "current_agent"))).alias("_a"))
    s = sessions.join(agents, "session_id", "left")
    names = F.transform(F.coalesce("_a", F.array()), lambda x: x["current_agent"])
    dur = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000
    return s.select("session_id", "user_id", F.array_join(names, ",").alias("agent_names_used"),
                    F.size(names).cast("bigint").alias("total_agents_used"),
                    F.floor(dur).cast("bigint").alias("session_duration_ms"))


def session_duration(sessions: DataFrame) -> DataFrame:
    """session_duration_date view; seconds counted as boundary crossings."""
    secs = F.unix_timestamp(F.col("updated_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return sessions.select("user_id", "session_id", F.to_date("created_at").alias("date"),
                           secs.cast("bigint").alias("sess_duration"))


def tool_definitions(tu: DataFrame) -> DataFrame:
    """Tool catalogue derived from usage: id, activity flag, cost per call."""
    return (tu.groupBy(F.col("tool_name").alias("name"))
              .agg(F.min("tool_call_id").alias("tool_id"))
              .withColumn("is_active", F.length("name") % 2 == 0)
              .withColumn("cost_per_call_cents", F.length("name").cast("int")))


def active_tools(td: DataFrame) -> DataFrame:
    """Active tool definitions."""
    return td.filter(F.col("is_active"))


def usage_kpis(ch: DataFrame, tu: DataFrame, td: DataFrame) -> DataFrame:
    """Sessions, messages, mean messages per session, tool calls, error rate, cost.

    Long form (metric, value): each block is a one-row global aggregate, stacked
    with a union rather than joined.
    """
    per_session = ch.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    msg = per_session.agg(F.count(F.lit(1)).cast("double").alias("total_sessions"),
                          F.sum("n").cast("double").alias("total_messages"),
                          F.round(F.avg(F.col("n").cast("double")), 4).alias("avg_session_length"))
    costs = td.select(F.col("name").alias("_n"), "cost_per_call_cents")
    calls = tu.join(costs, tu["tool_name"] == costs["_n"], "left")
    status = F.lower(F.coalesce("tool_output", F.lit(""))).contains("error")
    tools = calls.agg(F.count(F.lit(1)).cast("double").alias("total_tool_calls"),
                      F.round(F.avg(status.cast("double")), 6).alias("error_rate"),
                      F.coalesce(F.sum("cost_per_call_cents"), F.lit(0)).cast("double").alias("total_cost_cents"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                             for c in df.columns])).alias("m")).select("m.*")
    return long(msg).unionByName(long(tools))


def tool_stats(tu: DataFrame, td: DataFrame) -> DataFrame:
    """A39 (per tool): calls, errors, tokens and cost — the most-used-tools table."""
    costs = td.select(F.col("name").alias("tool_name"), "cost_per_call_cents")
    status = F.lower(F.coalesce("tool_output", F.lit(""))).contains("error")
    g = tu.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"),
                                    F.sum(status.cast("int")).cast("bigint").alias("errors"),
                                    F.sum("tokens_used").cast("bigint").alias("tokens"))
    return g.join(costs, "tool_name", "left").select(
        "tool_name", "calls", "errors", "tokens", (F.col("calls") * F.col("cost_per_call_cents")).cast("bigint")
        .alias("cost_cents"))


def recent_history(ch: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` messages of each session, numbered oldest first."""
    w = Window.partitionBy("session_id").orderBy(*[F.col(c).desc() for c in ORDER_KEYS])
    last = ch.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    cnt = last.groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    j = last.join(cnt, last["session_id"] == cnt["_s"]).drop("_s")
    return j.select("session_id", "user_id", "trace_id", "message_type", "content", "trace_end",
                    (F.col("_n") - F.col("_r") + 1).cast("bigint").alias("position"))


def rebuild_transcript(ch: DataFrame) -> DataFrame:
    """human/ai messages grouped by trace (traces in time order, D9), human before ai, then time."""
    msgs = ch.filter(F.col("message_type").isin("human", "ai"))
    first = msgs.groupBy(F.col("trace_id").alias("_t")).agg(F.min("trace_end").alias("_trace_first"))
    j = msgs.join(first, msgs["trace_id"] == first["_t"]).drop("_t")
    from .ordering import ordinal_within
    prio = F.when(F.col("message_type") == "human", PRIORITY["human"]).when(F.col("message_type") == "ai", PRIORITY["ai"]) \
        .otherwise(OTHER_PRIORITY)
    keyed = j.withColumn("_prio", prio)
    ranked = ordinal_within(keyed, "session_id", ["_trace_first", "trace_id", "_prio", "trace_end", "message_id"],
                            "position")
    return ranked.select("session_id", "trace_id", "message_type", "content", "position")


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Each user's sessions, most recently updated first (a user with very many sessions stays distributed)."""
    from .ordering import ordinal_within
    keyed = sessions.select("user_id", "session_id", "updated_at",
                            (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("_k1"),
                            (-F.col("session_id")).alias("_k2"))
    return ordinal_within(keyed, "user_id", ["_k1", "_k2"], "rank").drop("_k1", "_k2")


# ---------------------------------------------------------------- trace fan-out

def explode_trace(raw: DataFrame) -> dict[str, DataFrame]:
    """One raw agent trace -> chat_history, agent_traces and tool_usage rows.

    ``raw``: trace_id, session_id, user_id, nodes_list array<string>,
    event_times array<double> (seconds), messages array<string> (one JSON
    array of messages per step).  As in the reference: the first step's
    message list, when longer than two, is treated as replayed history and its
    first ``len - 2`` entries are skipped in every step; a human / ai message
    id is kept once per trace; a tool call is an AI message whose finish
    reason is ``tool_calls``.
    """
    from pyspark.sql.types import ArrayType

    from ..functions.json import MESSAGE_SCHEMA, message_fields

    steps = raw.select("trace_id", "session_id", "user_id",
                       F.posexplode(F.arrays_zip("nodes_list", "event_times", "messages")).alias("i", "s"))
    steps = steps.select("trace_id", "session_id", "user_id", (F.col("i") + 1).cast("int").alias("step"),
                         F.col("s.nodes_list").alias("agent_name"),
                         F.round(F.col("s.event_times") * 1000).cast("int").alias("duration_ms"),
                         F.from_json(F.col("s.messages"), ArrayType(MESSAGE_SCHEMA)).alias("msgs"))
    first = steps.filter(F.col("step") == 1).select(
        F.col("trace_id").alias("_t"),
        F.when(F.size("msgs") > 2, F.size("msgs") - 2).otherwise(0).alias("skip_n"))
    s = steps.join(first, steps["trace_id"] == first["_t"], "left").drop("_t")
    kept = s.select("*", F.posexplode(F.slice("msgs", F.coalesce("skip_n", F.lit(0)) + 1,
                                              F.greatest(F.size("msgs"), F.lit(1)))).alias("pos", "m"))
    f = kept.select("trace_id", "session_id", "user_id", "step", "pos", "agent_name", "duration_ms",
                    message_fields(F.col("m")).alias("f")).select("*", "f.*").drop("f")
    cls, fin = F.col("message_class"), F.col("finish_reason")
    mtype = (F.when(cls == "HumanMessage", "human")
              .when((cls == "AIMessage") & (F.coalesce(fin, F.lit("")) == "tool_calls"), "tool_call")
              .when(cls == "AIMessage", "ai").when(cls == "ToolMessage", "tool_result"))
    rows = f.withColumn("message_type", mtype).filter(F.col("message_type").isNotNull())
    rows = rows.withColumn("routing_step", F.when(F.col("message_type") == "human", 0).otherwise(F.col("step")))
    w = Window.partitionBy("trace_id", "message_key").orderBy("step", "pos")
    once = F.col("message_type").isin("human", "ai")
    rows = rows.withColumn("_r", F.when(once, F.row_number().over(w)).otherwise(F.lit(1))).filter("_r = 1").drop("_r")
    history = rows.select(
        F.col("message_key").alias("message_id"), "session_id", "trace_id", "user_id",
        F.when(F.col("message_type") != "human", F.col("agent_name")).alias("agent_name"), "routing_step",
        "message_type", "content", "total_tokens", "completion_tokens", "prompt_tokens", "model_name",
        "content_filter_results", "finish_reason",
        F.when(F.col("message_type") == "ai", F.col("duration_ms")).alias("response_time_ms"),
        F.coalesce("tool_call_id_out", "tool_call_id_in").alias("tool_call_id"),
        F.coalesce("tool_name", "tool_result_name").alias("tool_name"), "tool_input",
        F.when(F.col("message_type") == "tool_result", F.col("content")).alias("tool_output"))
    # a trace's steps come from the arrays of one raw row, so this window never
    # holds more than a single input row already held
    wt = Window.partitionBy("trace_id").orderBy("step")
    traces = steps.select("session_id", "trace_id", "user_id", F.col("step").alias("step_order"),
                          F.lag("agent_name", 1, "system").over(wt).alias("from_agent"),
                          F.col("agent_name").alias("current_agent"),
                          F.col("duration_ms").alias("execution_duration_ms"))
    usage = build_tool_usage(history.select("tool_call_id", "session_id", "trace_id", "message_type", "tool_name",
                                            "tool_input", "tool_output", "agent_name", "total_tokens"))
    return {"chat_history": history, "agent_traces": traces, "tool_usage": usage}
