"""Shared column functions and parameter helpers.

Time ranges are parameters, not data: they resolve on the driver to two
literals, so the filter is a constant that Catalyst pushes into the parquet
scan.  Everything that touches rows is a built-in expression.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from dateutil.relativedelta import relativedelta
from pyspark.sql import Column
from pyspark.sql import functions as F

# Start of "all time" and the month label format.
ALL_TIME_START = datetime(2000, 1, 1)
MONTH_LABEL = "MMM yyyy"


def _midnight(d: datetime) -> datetime:
    return d.replace(hour=0, minute=0, second=0, microsecond=0)


def time_range(name: str | None, as_of: datetime) -> tuple[datetime, datetime]:
    """Widget time range -> inclusive [start, as_of].  Unknown names mean six months."""
    if name == "last_6_months":
        start = as_of - relativedelta(months=6)
    elif name == "last_3_months":
        start = as_of - relativedelta(months=3)
    elif name in ("last_12_months", "last_year"):
        start = as_of - relativedelta(months=12)
    elif name == "this_year":
        start = _midnight(as_of).replace(month=1, day=1)
    elif name == "this_month":
        start = _midnight(as_of).replace(day=1)
    elif name == "last_30_days":
        start = as_of - timedelta(days=30)
    elif name == "last_7_days":
        start = as_of - timedelta(days=7)
    elif name == "all_time":
        start = ALL_TIME_START
    else:
        start = as_of - relativedelta(months=6)
    return start, as_of


def summary_period(text: str | None, as_of: datetime) -> tuple[datetime, datetime]:
    """Free-text period; case-insensitive substring tests, else this month."""
    t = (text or "").lower()
    if "last 6 months" in t:
        return as_of - relativedelta(months=6), as_of
    if "this year" in t:
        return as_of.replace(month=1, day=1, hour=0, minute=0, second=0), as_of
    return as_of.replace(day=1, hour=0, minute=0, second=0), as_of


def largest_period(name: str | None, as_of: datetime) -> tuple[datetime, datetime]:
    """Period of the largest-transaction tool; anything else is 120 months."""
    if name == "this_month":
        start = as_of.replace(day=1, hour=0, minute=0, second=0)
    elif name == "last_3_months":
        start = as_of - relativedelta(months=3)
    elif name == "last_6_months":
        start = as_of - relativedelta(months=6)
    elif name == "this_year":
        start = as_of.replace(month=1, day=1, hour=0, minute=0, second=0)
    else:
        start = as_of - relativedelta(months=120)
    return start, as_of


def ts_lit(value: datetime | date | str) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables store wall-clock timestamps)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(value).cast("timestamp_ntz")


def sql_ts(value: datetime) -> str:
    """The same literal for the DuckDB oracle."""
    return f"timestamp '{value.strftime('%Y-%m-%d %H:%M:%S.%f')}'"


def in_period(c: Column | str, start: datetime, end: datetime) -> Column:
    """P5: inclusive BETWEEN on a timestamp column."""
    c = F.col(c) if isinstance(c, str) else c
    return c.between(ts_lit(start), ts_lit(end))


def label(c: Column | str, default: str) -> Column:
    """NULL and '' both read as ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def money(c: Column | str) -> Column:
    """an exact decimal amount presented as a double rounded to cents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 2)


def signed_amount(type_col: str = "type", amount_col: str = "amount") -> Column:
    """Payments count negative, everything else positive."""
    return F.when(F.col(type_col) == "payment", -F.col(amount_col)).otherwise(F.col(amount_col))


def ms_to_s(c: Column | str) -> Column:
    """Milliseconds -> seconds, NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c / F.lit(1000.0)


# Wrapper tool names mapped to the canonical tool name.
TOOL_ALIASES = {
    "get_user_accounts_for_current_user": "get_user_accounts",
    "get_transactions_summary_for_current_user": "get_transactions_summary",
    "create_new_account_for_current_user": "create_new_account",
    "transfer_money_for_current_user": "transfer_money",
}


def canonical_tool(c: Column | str) -> Column:
    """Alias -> canonical tool name, unknown names unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in TOOL_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


# Coordinator answer -> (route, task_type); anything else is support.
ROUTES = {
    "visualization_agent": "visualization_management",
    "account_agent": "account_management",
}
DEFAULT_ROUTE = ("support_agent", "customer_support")


def route(answer: Column | str) -> Column:
    """Route label from the coordinator's answer (exact lower-case match)."""
    a = F.lower(F.col(answer) if isinstance(answer, str) else answer)
    agent = F.when(a == "visualization_agent", "visualization_agent").when(a == "account_agent", "account_agent") \
             .otherwise(DEFAULT_ROUTE[0])
    task = F.when(a == "visualization_agent", ROUTES["visualization_agent"]) \
            .when(a == "account_agent", ROUTES["account_agent"]).otherwise(DEFAULT_ROUTE[1])
    return F.struct(agent.alias("pass_to"), task.alias("task_type"))


def fmt_month(c: Column | str) -> Column:
    """F8: 'Mar 2024'."""
    return F.date_format(c, MONTH_LABEL)


def fmt_iso(c: Column | str) -> Column:
    """F8: ISO-8601 like Python's isoformat: the fraction only when microseconds are non-zero."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def fmt_day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def fmt_minute(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def month_spine(start: datetime, end: datetime) -> Column:
    """An array of month-start timestamps to ``explode`` per row (no join)."""
    first = datetime(start.year, start.month, 1)
    last = datetime(end.year, end.month, 1)
    return F.sequence(ts_lit(first), ts_lit(last), F.expr("interval 1 month"))


def sql_month_spine(start: datetime, end: datetime) -> str:
    """DuckDB twin of ``month_spine`` (one row per month, column ``month``)."""
    first = datetime(start.year, start.month, 1)
    last = datetime(end.year, end.month, 1)
    return (f"(select unnest(generate_series({sql_ts(first)}, {sql_ts(last)}, interval 1 month)) as month)")
