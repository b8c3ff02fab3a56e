"""Properties from the survey's test strategy (§5c)."""

from __future__ import annotations

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions.text import chunk
from ledgerlake.operators import banking as B
from ledgerlake.sources import fixtures as X


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", min_size=0, max_size=1300), min_size=1, max_size=6))
def test_chunks_count_and_overlap(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", chunk("t").alias("c")).collect():
        n = len(r["t"])
        assert len(r["c"]) == (math.ceil(n / 400) if n else 0)
        for a, b in zip(r["c"], r["c"][1:]):
            assert a[400:] == b[:100]                  # consecutive chunks overlap by 100 chars
        assert "".join(c[:400] for c in r["c"][:-1]) + (r["c"][-1] if r["c"] else "") == r["t"]


def test_categories_sum_to_the_summary_total(spark, small_dir):
    tx, acc = X.transactions(spark, small_dir), X.accounts(spark, small_dir)
    by_cat = B.spending_by_category(tx, acc, X.BANK_AS_OF, "this_year").groupBy("user_id") \
        .agg(F.round(F.sum("value"), 2).alias("s"))
    summary = B.transactions_summary(tx, acc, X.BANK_AS_OF, "this year").select("user_id", "total_spending")
    j = by_cat.join(summary, "user_id")
    assert j.count() > 0
    assert j.filter(F.abs(F.col("s") - F.col("total_spending")) > 0.011).count() == 0


def test_monthly_series_sum_to_period_spend(spark, small_dir):
    tx, acc = X.transactions(spark, small_dir), X.accounts(spark, small_dir)
    monthly = B.monthly_trend(tx, acc, X.BANK_AS_OF, "all_time").groupBy("user_id").agg(F.sum("value").alias("m"))
    cats = B.spending_by_category(tx, acc, X.BANK_AS_OF, "all_time").groupBy("user_id").agg(F.sum("value").alias("c"))
    j = monthly.join(cats, "user_id")
    assert j.filter(F.abs(F.col("m") - F.col("c")) > 0.05).count() == 0


def test_fraud_score_is_the_sum_of_finding_points(spark, small_dir):
    from ledgerlake.operators import fraud as FR
    p = FR.FraudParams(lookback_days=30, amount_floor=100.0, rapid_bucket="hour", round_unit=10)
    tt = X.timed_transactions(spark, small_dir)
    f = FR.fraud_findings(FR.in_window(tt, X.TIMED_AS_OF, p), p)
    pts = f.groupBy("user_id").agg(F.sum("risk_points").alias("pts"), F.count(F.lit(1)).alias("n"))
    rep = FR.fraud_report(tt, X.TIMED_AS_OF, p)
    j = rep.join(pts, "user_id", "left")
    assert j.filter(F.col("risk_score") != F.coalesce("pts", F.lit(0))).count() == 0
    assert j.filter(F.col("suspicious_count") != F.coalesce("n", F.lit(0))).count() == 0


def test_dropped_characters_are_those_not_kept(spark):
    from pyspark.sql import functions as F
    from ledgerlake.functions.text import DROP_CLASS, KEEP_CLASS, chunk_count
    points = [p for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF]
    rows = [("".join(map(chr, points[a:a + 4096])),) for a in range(0, len(points), 4096)]
    df = spark.createDataFrame(rows, "t string")
    kept, left = F.regexp_replace("t", KEEP_CLASS, ""), F.regexp_replace("t", DROP_CLASS, "")
    assert df.where(kept != left).count() == 0 and df.agg(F.sum(F.length(left))).first()[0] == 62 + 5 + 4 + 1 + 2 + 1 + 11 + 5
    sizes = spark.createDataFrame([(None,), ("",), ("x",), ("x" * 400,), ("x" * 401,)], "t string")
    assert [r[0] for r in sizes.select(chunk_count(F.col("t"))).collect()] == [0, 0, 1, 1, 2]
