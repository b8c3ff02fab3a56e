"""Content-safety analytics on the event table and chat history.

Every function takes a DataFrame and uses only built-in expressions, so the
same code runs on a batch frame or a streaming frame (``ledgerlake.streaming``
adds watermarks and sinks around it).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import fmt_iso, ts_lit

# The five safety categories, the marker of a filtered response,
# and the error-text fragment that flags each category.
CATEGORIES = ["hate", "jailbreak", "self_harm", "sexual", "violence"]
FILTERED_MARKER = "The response was filtered"
TRIGGERS = [f"'{c}': {{'filtered': True" for c in CATEGORIES]
# JSON paths of the ContentIssues view.
ISSUE_PATHS = [("hate", "filtered"), ("hate", "severity"), ("jailbreak", "filtered"), ("jailbreak", "detected"),
               ("self_harm", "filtered"), ("self_harm", "severity"), ("sexual", "filtered"), ("sexual", "severity"),
               ("violence", "filtered"), ("violence", "severity")]
NOT_BLOCKED = "User content Not blocked"


# ---------------------------------------------------------------- case-insensitive string predicates

def ci_startswith(c: Column | str, s: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c).startswith(s.lower())


def ci_contains(c: Column | str, s: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c).contains(s.lower())


def ci_not_contains(c: Column | str, s: str) -> Column:
    return ~ci_contains(c, s)


# ---------------------------------------------------------------- event counts R3-R8

def events_by_category(ev: DataFrame) -> DataFrame:
    """Events per (time, category) — the dashboard's first tile."""
    return ev.groupBy(F.col("timestamp").alias("DateTime"), "filter_category") \
        .agg(F.count(F.lit(1)).alias("eventCount"))


def allowed_events(ev: DataFrame) -> DataFrame:
    """Allowed events (category startswith "None") per time."""
    return ev.filter(ci_startswith("filter_category", "None")) \
        .groupBy(F.col("timestamp").alias("DateTime")).agg(F.count(F.lit(1)).alias("eventCount"))


def blocked_events(ev: DataFrame) -> DataFrame:
    """Blocked events (category !contains "None") per (time, category)."""
    return ev.filter(ci_not_contains("filter_category", "None")) \
        .groupBy(F.col("timestamp").alias("DateTime"), "filter_category").agg(F.count(F.lit(1)).alias("eventCount"))


def category_series(ev: DataFrame, category: str, op: str = "startswith") -> DataFrame:
    """One category's events per time (startswith in the query set, contains on the dashboard)."""
    pred = ci_startswith("filter_category", category) if op == "startswith" else ci_contains("filter_category", category)
    return ev.filter(pred).groupBy(F.col("timestamp").alias("DateTime")).agg(F.count(F.lit(1)).alias("eventCount"))


def all_category_series(ev: DataFrame, categories=("self_harm", "violence", "sexual", "jailbreak", "hate")) -> DataFrame:
    """R6 for every category in one pass: explode the matching names, one groupBy (no per-category scan)."""
    lc = F.lower("filter_category")
    hits = F.filter(F.array(*[F.lit(c) for c in categories]), lambda c: lc.startswith(c))
    return ev.select("timestamp", F.explode(hits).alias("category")) \
        .groupBy("category", F.col("timestamp").alias("DateTime")).agg(F.count(F.lit(1)).alias("eventCount"))


def recent(ev: DataFrame, as_of: datetime, span: timedelta = timedelta(hours=1), col: str = "timestamp") -> DataFrame:
    """Events in (as_of - span, as_of].

    On a landed table partitioned by ``event_date`` the same window is also
    stated on the partition column, so only the touched dates are listed and read.
    """
    out = ev.filter((F.col(col) > ts_lit(as_of - span)) & (F.col(col) <= ts_lit(as_of)))
    if "event_date" in ev.columns:
        out = out.filter(F.col("event_date").between(F.lit((as_of - span).date()), F.lit(as_of.date())))
    return out


def retain(ev: DataFrame, as_of: datetime, span: timedelta = timedelta(days=1), col: str = "timestamp") -> DataFrame:
    """The retention window of the event table (1 day)."""
    return recent(ev, as_of, span, col)


# ---------------------------------------------------------------- JSON (F3, F7) and views

def json_value(c: Column, path: str) -> Column:
    """JSON_VALUE: a scalar at ``path`` as text; objects / arrays / missing -> NULL."""
    v = F.get_json_object(c, path)
    return F.when(v.startswith("{") | v.startswith("["), F.lit(None).cast("string")).otherwise(v)


def filter_fields(c: Column | str) -> list[Column]:
    """the ten ContentIssues columns."""
    c = F.col(c) if isinstance(c, str) else c
    return [json_value(c, f"$.{cat}.{field}").alias(f"{cat}_{field}") for cat, field in ISSUE_PATHS]


def content_issues(ch: DataFrame) -> DataFrame:
    """ContentIssues view (all ai messages, D5) plus an ``is_issue`` flag."""
    ai = ch.filter(F.col("message_type") == "ai")
    if "agent_id" not in ai.columns:
        ai = ai.withColumn("agent_id", F.lit(None).cast("bigint"))
    v = ai.select("session_id", "trace_id", "user_id", "agent_id", "message_type", "content", "content_filter_results",
                  *filter_fields("content_filter_results"))
    flagged = [F.col(f"{cat}_{field}") == "true" for cat, field in ISSUE_PATHS if field in ("filtered", "detected")]
    severe = [F.coalesce(F.col(f"{cat}_severity") != "safe", F.lit(False)) for cat, field in ISSUE_PATHS
              if field == "severity"]
    issue = F.lit(False)
    for p in flagged:
        issue = issue | F.coalesce(p, F.lit(False))
    for p in severe:
        issue = issue | p
    return v.withColumn("is_issue", issue)


def safety_category(error_text: Column | str) -> Column:
    """(filter_category, content_filter_results JSON) from an error text.

    Only texts containing the filtered-response marker count; the five
    triggers are tested in order, the last match names the category and every
    match is marked in the filter document.
    """
    e = F.col(error_text) if isinstance(error_text, str) else error_text
    marked = e.contains(FILTERED_MARKER)
    hit = {c: marked & e.contains(t) for c, t in zip(CATEGORIES, TRIGGERS)}
    cat = F.lit("unknown")
    for c in CATEGORIES:  # later matches override earlier ones
        cat = F.when(hit[c], F.lit(c)).otherwise(cat)
    parts = []
    for c in CATEGORIES:
        if c == "jailbreak":
            parts.append(F.struct(hit[c].alias("filtered"), hit[c].alias("detected")).alias(c))
        else:
            parts.append(F.struct(hit[c].alias("filtered"),
                                  F.when(hit[c], "high").otherwise("safe").alias("severity")).alias(c))
    return F.struct(cat.alias("filter_category"), F.to_json(F.struct(*parts)).alias("content_filter_results"))


# ---------------------------------------------------------------- row fan-out

def violations_to_rows(ev: DataFrame) -> DataFrame:
    """Each blocked request becomes a human row (if a user message), an ai row and a trace row."""
    blocked = ev.filter(ci_not_contains("filter_category", "None"))
    human = F.struct(F.lit("chat_history").alias("target"), F.lit("human").alias("message_type"),
                     F.lit(0).alias("routing_step"), F.col("user_message").alias("content"),
                     F.lit(None).cast("string").alias("from_agent"), F.lit(None).cast("string").alias("current_agent"))
    ai = F.struct(F.lit("chat_history").alias("target"), F.lit("ai").alias("message_type"), F.lit(1).alias("routing_step"),
                  F.col("message").alias("content"), F.lit(None).cast("string").alias("from_agent"),
                  F.col("agent_name").alias("current_agent"))
    trace = F.struct(F.lit("agent_traces").alias("target"), F.lit(None).cast("string").alias("message_type"),
                     F.lit(1).alias("routing_step"), F.lit(None).cast("string").alias("content"),
                     F.lit("system").alias("from_agent"), F.col("agent_name").alias("current_agent"))
    rows = F.when(F.col("user_message").isNotNull(), F.array(human, ai, trace)).otherwise(F.array(ai, trace))
    return blocked.select("trace_id", "session_id", "user_id", "filter_category", F.explode(rows).alias("r")) \
        .select("trace_id", "session_id", "user_id", "filter_category", "r.*")


def trace_to_events(ch: DataFrame) -> DataFrame:
    """One JSON event per agent step (the human question of the trace rides along)."""
    q = ch.filter(F.col("message_type") == "human").groupBy(F.col("trace_id").alias("_t")) \
        .agg(F.min_by("content", "routing_step").alias("user_message"))
    steps = ch.filter(F.col("message_type") == "ai")
    j = steps.join(q, steps["trace_id"] == q["_t"], "left")
    ev = F.struct(fmt_iso("trace_end").alias("timestamp"), "trace_id", "session_id",
                  "user_id", F.col("content").alias("message"), "agent_name", "user_message",
                  F.lit("None").alias("filter_category"), F.lit(NOT_BLOCKED).alias("content_filter_info"))
    # every key is emitted, missing values as null (like the reference's json.dumps of its dict)
    return j.select("trace_id", "routing_step", F.to_json(ev, {"ignoreNullFields": "false"}).alias("event"))


def blocked_to_events(blocked: DataFrame) -> DataFrame:
    """S16 (failure path): a blocked request emits one event carrying its category and filter details."""
    ev = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "trace_id",
                  "session_id", "user_id", "message", "agent_name", "user_message", "filter_category",
                  "content_filter_info")
    return blocked.filter(ci_not_contains("filter_category", "None")).select("trace_id", F.to_json(ev).alias("event"))
