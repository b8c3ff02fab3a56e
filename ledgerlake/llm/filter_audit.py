"""How quality filters of documents act on one another, in every order.

A and B are decided by the sparse document-term matrix (see ``doc_term``): a
row's sum is its number of words, its entries that aren't zero are its distinct
words.  The other signals of a text are measured in the same pass.  A document
that fails several filters is removed by the first of them in the order, so the
counts of all orders follow from how many documents fail each set of filters.

Filters: A, under 100 words; B, under 80 distinct words of 100; C, over 10
capitals A-Z of 100 code points; D, any of #$%&*|; E, equal to the text of a
smaller doc_id.  A null text is an empty one.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import doc_term
from .common import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#$%&*|")] = True


def _measure(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Code points, capitals and whether a sign occurs, of every text."""
    def per_text(hit: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(hit, out=total[1:])
        return np.diff(total[offsets])
    return [per_text((raw & 0xC0) != 0x80), per_text((raw >= 65) & (raw <= 90)), per_text(_SIGN[raw]) > 0]


def signals(docs: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part, digest (of the text), words, distinct, chars, capitals and signs of every document."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(part).alias("part"), F.col(text).alias("text"),
                       F.unhex(F.sha2(F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b"")), 256)).alias("digest"))
    shards = doc_term.shard_rows(rows, ["id", "part", "digest"], "text", _measure,
                                 {"chars": pa.int64(), "capitals": pa.int64(), "signs": pa.bool_()})

    def decide(rows: pa.StructArray, entries: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        at = np.concatenate([[0], np.cumsum(entries)])
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        nonzero = np.concatenate([[0], np.cumsum((ids >= 0) & (counts > 0))])
        return pa.table([*rows.flatten(), pa.array(np.diff(total[at])), pa.array(np.diff(nonzero[at]))],
                        names=["id", "part", "digest", "chars", "capitals", "signs", "words", "distinct"])

    kind = rows.schema
    return doc_term.encoded(shards, doc_term.dictionary(shards), decide,
                            f"id {kind['id'].dataType.simpleString()}, part {kind['part'].dataType.simpleString()}, digest binary, "
                            "chars long, capitals long, signs boolean, words long, distinct long")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """id, part (null: empty string), fails (a bit per filter that the document fails), good and toxic.

    A document is good (toxic) if any of its labels says so.  A document without
    an id equals no smaller one; rows that share an id and a text are all the
    first of that text.  Repeated rows count each.
    """
    rows = materialize(signals(docs, part), "signals")
    # a row per distinct text, found again by the row's own id: no text's copies meet in one task
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")) \
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    fail = [F.col("words") < MIN_WORDS, 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"),
            100 * F.col("capitals") > CAPITALS_PERCENT * F.col("chars"), F.col("signs"),
            F.col("id").isNotNull() & F.col("first").isNull()]
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fail)), F.lit(0))
    return rows.join(first, ["digest", "id"], "left").join(marks, "id", "left").select(
        "id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), bits.alias("fails"),
        F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


def audit(failed: DataFrame) -> DataFrame:
    """Counts of every part, order of the filters and step; see ``failures`` for the input.

    At most 2**5 rows per part are left before the orders are spread out.
    """
    cells = failed.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))) \
        .withColumn("bit", F.expr(f"1 << (ascii(substr(filter_order, step, 1)) - {ord(FILTERS[0])})")) \
        .withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, "
                                     f"(b, f) -> b | (1 << (ascii(f) - {ord(FILTERS[0])})))"))
    orders_of_all = len(list(permutations(FILTERS)))

    def total(which: str, what: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {which}), 0L, (s, c) -> s + {what})")

    here, earlier = "c.fails & bit <> 0", "c.fails & before <> 0"
    return steps.select(
        "part", "filter_order", "step",
        total("c.fails & (before | bit) = 0").alias("kept"), total(f"{here} and not ({earlier})").alias("removed"),
        total(f"{here} and {earlier}").alias("redundant"), total("c.fails = bit").alias("unique_fails"),
        total(f"{here} and not ({earlier})", "c.good").alias("good_lost"),
        total(f"{here} and not ({earlier})", "c.toxic").alias("toxic_lost"),
        # of the orders, the filter comes first among those that the document fails in one of bit_count(fails)
        total(here, f"c.n * {orders_of_all} div bit_count(c.fails)").alias("shapley"))
