"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of an edge (a, b).

    Each round hangs every node's larger neighbours on its smallest one (large
    star), then its smaller ones (small star); a logarithmic number of rounds
    leaves stars.  Neighbours are aggregated and joined, never gathered, so a
    hub may have any number of them.  Loops and repeated edges are allowed.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(after, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
