"""Star-schema denormalisation and implicit SUM measures.

Relationships are metadata; ``star_view`` walks them from a fact table and
left-joins each reachable dimension once (many-to-one, so no fan-out).
Dimension columns come back prefixed ``<table>__<column>``.  An inactive,
role-playing relationship (transactions.from_account_id -> accounts) is only
followed when asked, under its own prefix.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The semantic model's relationships (from_table, from_column,
# to_table, to_column, active).  accounts -> users uses accounts.user_id.
RELATIONSHIPS = [
    ("accounts", "user_id", "users", "user_id", True),
    ("agent_traces", "session_id", "chat_sessions", "session_id", True),
    ("chat_history", "agent_id", "agent_definitions", "agent_id", True),
    ("chat_history", "session_id", "chat_sessions", "session_id", True),
    ("tool_usage", "tool_id", "tool_definitions", "tool_id", True),
    ("chat_history", "tool_call_id", "tool_usage", "tool_call_id", True),
    ("chat_sessions", "user_id", "users", "user_id", True),
    ("session_duration_date", "session_id", "chat_sessions", "session_id", True),
    ("transactions", "to_account_id", "accounts", "account_id", True),
    ("transactions", "from_account_id", "accounts", "account_id", False),
    ("ai_widgets", "user_id", "users", "user_id", True),
    ("chat_history", "trace_id", "ContentIssues", "trace_id", True),
    ("chat_history", "trace_id", "UserAsks", "trace_id", True),
]
# Views keyed by trace are not one-to-one with chat_history; they are not walked.
MANY_SIDED = {"ContentIssues", "UserAsks"}

# The BI model's implicit SUM measures (table, column).
SUM_MEASURES = [("accounts", "balance"), ("transactions", "amount"), ("chat_history", "total_tokens"),
                ("chat_history", "completion_tokens"), ("chat_history", "prompt_tokens"), ("tool_usage", "tokens_used"),
                ("agent_traces", "execution_duration_ms"), ("agent_traces", "step_order"),
                ("session_duration_date", "sess_duration"), ("chat_sessions", "session_duration_ms"),
                ("chat_sessions", "total_agents_used")]


def star_view(tables: dict[str, DataFrame], fact: str, role_playing: dict[str, str] | None = None) -> DataFrame:
    """The fact table with every reachable dimension left-joined once.

    ``role_playing`` maps ``"<from_table>.<from_column>"`` of an inactive
    relationship to the prefix to use, e.g. {"transactions.from_account_id": "from_account"}.
    """
    out = tables[fact]
    seen = {fact}
    queue = deque([(fact, fact, None)])      # (table, how it is addressed in `out`, prefix)
    role_playing = role_playing or {}
    while queue:
        table, _, prefix = queue.popleft()
        for ft, fc, tt, tc, active in RELATIONSHIPS:
            if ft != table or tt in MANY_SIDED or tt not in tables:
                continue
            key = f"{ft}.{fc}"
            if not active and key not in role_playing:
                continue
            new_prefix = role_playing.get(key, tt) if not active else tt
            if active and tt in seen:
                continue
            src_col = fc if prefix is None else f"{prefix}__{fc}"
            if src_col not in out.columns:
                continue
            dim = tables[tt]
            dim = dim.select([F.col(c).alias(f"{new_prefix}__{c}") for c in dim.columns])
            out = out.join(dim, out[src_col] == dim[f"{new_prefix}__{tc}"], "left")
            seen.add(tt)
            if active:
                queue.append((tt, tt, new_prefix))
    return out


def measure(star: DataFrame, column: str, dims: list[str], name: str | None = None) -> DataFrame:
    """Implicit SUM of ``column`` by any dimension columns of the star."""
    return star.groupBy(*dims).agg(F.sum(column).alias(name or f"sum_{column.split('__')[-1]}"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Every implicit SUM measure that the given tables have: table_name, column_name, total (one aggregate per table)."""
    out = None
    for name in dict.fromkeys(t for t, _ in SUM_MEASURES if t in tables):
        columns = [c for t, c in SUM_MEASURES if t == name and c in tables[name].columns]
        if not columns:
            continue
        sums = tables[name].agg(*[F.sum(c).cast("double").alias(c) for c in columns])
        rows = sums.unpivot([], columns, "column_name", "total").select(F.lit(name).alias("table_name"), "column_name", "total")
        out = rows if out is None else out.unionByName(rows)
    return out
