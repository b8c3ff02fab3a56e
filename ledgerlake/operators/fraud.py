"""Fraud screening for every user at once.

Input is a scoped frame ``(user_id, id, amount, created_at, description,
status)``: ``timed_transactions`` as is, or bank transactions after
``banking.user_scope(tx, acc, "from")``.  Per-user statistics are a
``groupBy`` joined back (partial aggregation absorbs a hot user; AQE splits
a skewed join), never a window over all of a user's rows.

The report reads the transactions twice: once into sums per user and time
bucket, which give the statistics and the rapid findings, and once for the rows
that any check on single rows may find, each with an array of its findings.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import fmt_day, fmt_minute, in_period, money

# Finding types, their points and their order in a report.
CHECKS = [("UNUSUAL_AMOUNT", 2), ("RAPID_TRANSACTIONS", 3), ("UNUSUAL_TIME", 1), ("ROUND_AMOUNT", 1)]
CHECK_NAMES = {"unusual_amounts": "UNUSUAL_AMOUNT", "rapid_transactions": "RAPID_TRANSACTIONS",
               "unusual_time": "UNUSUAL_TIME", "round_amounts": "ROUND_AMOUNT"}
# Why a finding is one.
REASONS = {"RAPID_TRANSACTIONS": "transactions within 5 minutes",
           "UNUSUAL_TIME": "Large transaction during unusual hours (11pm-5am)",
           "ROUND_AMOUNT": "Round dollar amount (common in fraud)"}
# Risk bands (score >= 10 HIGH, >= 5 MEDIUM, > 0 LOW, else NONE) and their advice.
HIGH, MEDIUM = 10, 5
RECOMMENDATIONS = {
    "HIGH": "🚨 Contact your bank immediately to review these transactions",
    "MEDIUM": "⚠️ Review these transactions carefully",
    "LOW": "ℹ️ Minor anomalies detected, monitor your account",
    "NONE": "✓ No suspicious activity detected",
}

#: Parts that a user's findings are spread over before the first ones are taken.
SPREAD = 32


@dataclass(frozen=True)
class FraudParams:
    lookback_days: int = 7
    amount_multiple: int = 3         # amount > multiple x user mean ...
    amount_floor: float = 500.0      # ... and amount > floor
    rapid_bucket: str = "minute"     # D6: the reference buckets per minute
    rapid_min: int = 3
    night_start: int = 23
    night_end: int = 5
    night_amount: float = 200.0
    round_min: float = 100.0
    round_unit: int = 100
    max_findings: int = 10

    def window(self, as_of: datetime) -> tuple[datetime, datetime]:
        days = min(max(1, self.lookback_days), 30)
        return as_of - timedelta(days=days), as_of


def in_window(scoped: DataFrame, as_of: datetime, p: FraudParams) -> DataFrame:
    start, end = p.window(as_of)
    return scoped.filter((F.col("status") == "completed") & in_period("created_at", start, end))


def _stats(t: DataFrame) -> DataFrame:
    return t.groupBy("user_id").agg(F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_n"),
                                    F.max("amount").alias("_max"))


def fraud_unusual_amount(t: DataFrame, p: FraudParams) -> DataFrame:
    """Amount > multiple x mean and > floor (compared as amount * n > multiple * sum, exact)."""
    j = t.join(_stats(t), "user_id")
    hit = (F.col("amount") * F.col("_n") > F.col("_sum") * p.amount_multiple) & (F.col("amount") > p.amount_floor)
    return j.filter(hit).select("user_id", F.lit("UNUSUAL_AMOUNT").alias("type"), F.col("id").alias("transaction_id"),
                                money("amount").alias("amount"), F.col("created_at").alias("event_at"),
                                fmt_minute("created_at").alias("time"), "description", F.lit(2).alias("risk_points"))


def fraud_rapid(t: DataFrame, p: FraudParams) -> DataFrame:
    """>= rapid_min transactions in one time bucket."""
    b = F.date_trunc(p.rapid_bucket, "created_at").cast("timestamp_ntz")   # keep wall-clock type
    g = t.groupBy("user_id", b.alias("event_at")).agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("_tot"),
                                               F.max("id").alias("_last_id"))
    return g.filter(F.col("count") >= p.rapid_min).select(
        "user_id", F.lit("RAPID_TRANSACTIONS").alias("type"), F.lit(None).cast("bigint").alias("transaction_id"),
        money("_tot").alias("amount"), "event_at", fmt_minute("event_at").alias("time"),
        F.lit(None).cast("string").alias("description"), F.lit(3).alias("risk_points"),
        F.col("count").cast("bigint").alias("count"))


def fraud_unusual_time(t: DataFrame, p: FraudParams) -> DataFrame:
    """Hour >= night_start or <= night_end, amount > night_amount."""
    return t.filter(_night(p)).select("user_id", F.lit("UNUSUAL_TIME").alias("type"), F.col("id").alias("transaction_id"),
                                money("amount").alias("amount"), F.col("created_at").alias("event_at"),
                                fmt_minute("created_at").alias("time"), "description", F.lit(1).alias("risk_points"))


def fraud_round_amount(t: DataFrame, p: FraudParams) -> DataFrame:
    """Amount >= round_min and a multiple of round_unit (decimal arithmetic)."""
    return t.filter(_round(p)).select("user_id", F.lit("ROUND_AMOUNT").alias("type"), F.col("id").alias("transaction_id"),
                                money("amount").alias("amount"), F.col("created_at").alias("event_at"),
                                fmt_day("created_at").alias("time"), "description", F.lit(1).alias("risk_points"))


def _chosen(check_type: str) -> list[str]:
    return [n for n, _ in CHECKS] if check_type == "all" else [CHECK_NAMES[check_type]]


def _night(p: FraudParams) -> Column:
    h = F.hour("created_at")
    return ((h >= p.night_start) | (h <= p.night_end)) & (F.col("amount") > p.night_amount)


def _round(p: FraudParams) -> Column:
    return (F.col("amount") >= p.round_min) & (F.col("amount") % p.round_unit == 0)


def _candidates(t: DataFrame, p: FraudParams, chosen: list[str]) -> DataFrame:
    """The rows that a check on single rows may find; a mean is not needed to rule the others out."""
    may = {"UNUSUAL_AMOUNT": F.col("amount") > p.amount_floor, "UNUSUAL_TIME": _night(p), "ROUND_AMOUNT": _round(p)}
    any_of = F.lit(False)
    for name in chosen:
        any_of = any_of | may.get(name, F.lit(False))
    return t.filter(any_of).select("user_id", "id", "amount", "created_at", "description")


def _finding(name: str, at: Column, transaction: Column, amount: Column, time: Column, description: Column,
             count: Column, reason: Column) -> Column:
    """One finding; structs sort in report order: check, newest first, transaction."""
    order = [n for n, _ in CHECKS].index(name)
    return F.struct(
        F.lit(order).alias("check_order"), (-F.unix_micros(at.cast("timestamp"))).alias("newest"),
        transaction.cast("bigint").alias("transaction_id"), F.lit(name).alias("type"), amount.alias("amount"),
        at.alias("event_at"), time.alias("time"), description.cast("string").alias("description"),
        count.cast("bigint").alias("count"), reason.alias("reason"), F.lit(CHECKS[order][1]).alias("risk_points"))


def _row_findings(p: FraudParams, chosen: list[str]) -> Column:
    """The array of findings of a transaction that has its user's ``_n``, ``_sum`` and ``_mean`` beside it."""
    c, none = F.col, F.lit(None)
    dollars = lambda x: F.concat(F.lit("$"), x.cast("decimal(18,2)").cast("string"))
    checks = {
        "UNUSUAL_AMOUNT": (
            (c("amount") * c("_n") > c("_sum") * p.amount_multiple) & (c("amount") > p.amount_floor), fmt_minute("created_at"),
            F.concat(F.lit("Amount "), dollars(c("amount")), F.lit(f" is {p.amount_multiple}x higher than your average "),
                     dollars(c("_mean")))),
        "UNUSUAL_TIME": (_night(p), fmt_minute("created_at"), F.lit(REASONS["UNUSUAL_TIME"])),
        "ROUND_AMOUNT": (_round(p), fmt_day("created_at"), F.lit(REASONS["ROUND_AMOUNT"])),
    }
    found = [F.when(hit & F.lit(name in chosen),
                    _finding(name, c("created_at"), c("id"), money("amount"), time, c("description"), none, reason))
             for name, (hit, time, reason) in checks.items()]
    return F.array_compact(F.array(*found))


def _buckets(t: DataFrame, p: FraudParams) -> DataFrame:
    start = F.date_trunc(p.rapid_bucket, "created_at").cast("timestamp_ntz")
    return t.groupBy("user_id", start.alias("_start")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("amount").alias("_known"), F.sum("amount").alias("_sum"), F.max("amount").alias("_max"))


def _burst() -> Column:
    return _finding("RAPID_TRANSACTIONS", F.col("_start"), F.lit(None), money("_sum"), fmt_minute("_start"), F.lit(None),
                    F.col("_n"), F.concat(F.col("_n").cast("string"), F.lit(" " + REASONS["RAPID_TRANSACTIONS"])))


def _mean(total: str, known: str) -> Column:
    return F.round(F.col(total).cast("double") / F.col(known), 2)


def _profiles(t: DataFrame, p: FraudParams, chosen: list[str]) -> DataFrame:
    """Per user: the statistics, the number of rapid buckets and the newest ``max_findings`` of them.

    A user has as many buckets as the window has minutes at most (30 days).
    """
    rapid = (F.col("_n") >= p.rapid_min) & F.lit("RAPID_TRANSACTIONS" in chosen)
    return _buckets(t, p).groupBy("user_id").agg(
        F.sum("_n").alias("_n"), F.sum("_known").alias("_known"), F.sum("_sum").alias("_sum"), F.max("_max").alias("_max"),
        F.count_if(rapid).alias("_bursts"),
        F.slice(F.array_sort(F.collect_list(F.when(rapid, _burst()))), 1, p.max_findings).alias("_rapid"),
    ).withColumn("_mean", _mean("_sum", "_known"))


def fraud_findings(t: DataFrame, p: FraudParams, check_type: str = "all") -> DataFrame:
    """Every finding of the selected checks with its details and reason, in one shape with the report order."""
    chosen = _chosen(check_type)
    means = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.count("amount").alias("_known"), F.sum("amount").alias("_sum")) \
        .withColumn("_mean", _mean("_sum", "_known"))
    of_rows = _candidates(t, p, chosen).join(means, "user_id").select("user_id", F.explode(_row_findings(p, chosen)).alias("f"))
    if "RAPID_TRANSACTIONS" in chosen:
        of_rows = of_rows.unionByName(_buckets(t, p).filter(F.col("_n") >= p.rapid_min).select("user_id", _burst().alias("f")))
    return of_rows.select("user_id", "f.*").drop("newest")


NO_TRANSACTIONS = "No transactions found in the specified period"


def fraud_report(scoped: DataFrame, as_of: datetime, p: FraudParams = FraudParams(),
                 check_type: str = "all", users: DataFrame | None = None) -> DataFrame:
    """Score, level, first findings (an array of structs with details and reason) and statistics per user.

    Users with transactions in the window are reported; with ``users`` (one
    ``user_id`` per user that has accounts) the others get a NONE row and the
    reference's "no transactions" message.
    """
    chosen = _chosen(check_type)
    t = in_window(scoped, as_of, p)
    people = _profiles(t, p, chosen)
    stats = ["_n", "_known", "_mean", "_max", "_bursts", "_rapid"]
    found = people.join(_candidates(t, p, chosen), "user_id", "left") \
        .select("user_id", *stats, F.pmod(F.xxhash64("id"), F.lit(SPREAD)).alias("_part"),
                F.explode_outer(_row_findings(p, chosen)).alias("f"))
    # first in parts of a user, whose sums stand in each part's first row, then of what the parts kept;
    # candidates without a finding are null there and last
    part = Window.partitionBy("user_id", "_part")
    first = found.withColumn("_count", F.count("f").over(part)).withColumn("_points", F.sum("f.risk_points").over(part)) \
        .withColumn("_r", F.row_number().over(part.orderBy(F.col("f").asc_nulls_last()))).filter(F.col("_r") <= p.max_findings)
    once = F.col("_r") == 1
    rapid_points = dict(CHECKS)["RAPID_TRANSACTIONS"]
    j = first.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(once, F.col("_count"))), F.lit(0)).alias("_count"),
        F.coalesce(F.sum(F.when(once, F.col("_points"))), F.lit(0)).alias("_points"),
        F.collect_list("f").alias("_kept"), *[F.first(c).alias(c) for c in stats]).select(
        "user_id", (F.col("_points") + F.col("_bursts") * rapid_points).alias("risk_score"),
        (F.col("_count") + F.col("_bursts")).alias("suspicious_count"),
        F.slice(F.array_sort(F.concat("_kept", "_rapid")), 1, p.max_findings).alias("_top"),
        F.col("_mean").alias("average_amount"), money("_max").alias("highest_amount"), F.col("_n").alias("transaction_count"))
    if users is not None:
        j = users.select("user_id").distinct().join(j, "user_id", "left")
    s = F.coalesce("risk_score", F.lit(0)).cast("bigint")
    level = F.when(s >= HIGH, "HIGH").when(s >= MEDIUM, "MEDIUM").when(s > 0, "LOW").otherwise("NONE")
    advice = F.when(s >= HIGH, RECOMMENDATIONS["HIGH"]).when(s >= MEDIUM, RECOMMENDATIONS["MEDIUM"]) \
        .when(s > 0, RECOMMENDATIONS["LOW"]).otherwise(RECOMMENDATIONS["NONE"])
    days = min(max(1, p.lookback_days), 30)
    return j.select(
        "user_id", s.alias("risk_score"), level.alias("risk_level"), advice.alias("recommendation"),
        F.lit(f"{days} days").alias("period_analyzed"),
        F.coalesce("suspicious_count", F.lit(0)).cast("bigint").alias("suspicious_count"),
        F.when(F.col("_top").isNull(), F.array()).otherwise(
            F.transform("_top", lambda x: x.dropFields("check_order", "newest", "event_at"))).alias("findings"),
        "average_amount", "highest_amount",
        F.coalesce("transaction_count", F.lit(0)).cast("bigint").alias("transaction_count"),
        F.when(F.col("transaction_count").isNull(), F.lit(NO_TRANSACTIONS)).alias("message"),
    )


def report_findings(report: DataFrame) -> DataFrame:
    """One row per finding of a report, numbered from 1 in report order."""
    return report.select("user_id", F.posexplode("findings").alias("_at", "f")) \
        .select("user_id", (F.col("_at") + 1).alias("position"), "f.*")
