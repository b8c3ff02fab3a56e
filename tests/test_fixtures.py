"""The derived tables reproduce the checked values of FIXTURES.md (sf0.01)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import chunk_count, clean_text
from ledgerlake.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def test_bank_tables(spark):
    assert X.users(spark, SF).count() == 500
    acc = X.accounts(spark, SF)
    assert acc.count() == 1500
    assert float(acc.agg(F.sum("balance")).first()[0]) == pytest.approx(6743588.96)
    kinds = {r[0]: r[1] for r in acc.groupBy("account_type").count().collect()}
    assert kinds == {"savings": 921, "checking": 457, "credit": 122}
    tx = X.transactions(spark, SF)
    assert tx.count() == 15000 and tx.select("id").distinct().count() == 15000
    assert float(tx.agg(F.sum("amount")).first()[0]) == pytest.approx(3758439620.06)
    assert tx.filter(F.col("category").isNotNull()).count() == 11980
    tt = X.timed_transactions(spark, SF)
    assert tt.count() == 10000 and float(tt.agg(F.sum("amount")).first()[0]) == pytest.approx(496306.57)
    assert tt.select("user_id").distinct().count() == 150


def test_chat_tables(spark):
    ch = X.chat_history(spark, SF)
    kinds = {r[0]: r[1] for r in ch.groupBy("message_type").count().collect()}
    assert kinds == {"human": 279, "ai": 233, "system": 24}
    assert ch.filter(F.col("message_type") == "ai").select("trace_id").distinct().count() == 143
    hate = {r[0]: r[1] for r in ch.groupBy(F.get_json_object("content_filter_results", "$.hate.filtered")).count().collect()}
    assert hate == {"true": 23, "false": 210, None: 303}
    ev = X.agentic_events(spark, SF)
    assert ev.count() == 10000 and ev.filter(F.col("filter_category") == "None").count() == 3988


def test_document_chunk_counts(spark):
    docs = X.chunk_source(spark, SF)
    raw = docs.agg(F.sum(F.length("text")).alias("c"), F.sum(chunk_count(F.col("text"))).alias("n")).first()
    assert (raw["c"], raw["n"]) == (2409870, 6540)
    cleaned = docs.select(clean_text("text").alias("t"))
    cl = cleaned.agg(F.sum(F.length("t")).alias("c"), F.sum(chunk_count(F.col("t"))).alias("n")).first()
    assert (cl["c"], cl["n"]) == (2235460, 6115)
