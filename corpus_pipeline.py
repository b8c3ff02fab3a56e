"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents; the last adds mix_position and ids.  Empty
tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm import bpe, mixing, ngram_join, quality
from ledgerlake.llm.common import materialize, table
from ledgerlake.llm.queries import BLOCK_ROWS, OTHER_WEIGHT, RANKS, WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject (score of at least 0.3).

    Null and empty texts are scored as texts without words.  Documents without a
    label are judged like all others; a document labelled twice is learned from
    as often.  A score of just 0.3 stays.
    """
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 1).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (word 5-grams, similarity of at least 0.8).

    The row with the smallest id stays, rows without an id last; of several with
    that id the first in the written files.  Every row counts by its place there,
    so neither a repeated nor a missing id lets a copy through.  Each row without
    words (null, empty or blank text) is a group of its own and stays.  An empty
    table stays empty.
    """
    rows = in_files(docs if docs.inputFiles() else materialize(docs, "rows"))
    doc_id = F.col("_row.doc_id")
    keyed = rows.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "_place").alias("id"),
                        F.col("_row.text").alias("text"))
    groups = ngram_join.join_components(keyed, 5, 80, "id")
    chosen = groups.where("id = component_id").select("id._place")
    return rows.join(chosen, "_place", "left_semi").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix; the files, read by name, follow it, and the next stage numbers the rows by them.

    Null texts are kept; rows without a source form one of their own.  Within a
    source rows follow doc_id, nulls first; rows with equal ids the hash of their
    columns, so only equal rows may change places.
    """
    mixed = mixing.mix(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_ROWS)
    return mixing.in_mixed_order(mixed).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix (mix_position) and the ids of its whole text instead of the text.

    The place is that of the row in the written files, taken by name.  Documents
    that weren't read from files have none.
    """
    return bpe.encode(placed(spark, docs), RANKS, public_tokenizers.PATTERN).drop("text")


def in_files(docs: DataFrame) -> DataFrame:
    """The rows of a table read from files: _row (a struct of its columns) and _place.

    Places count from 0, by file name and row of the file; the running sum is
    over one row per file.
    """
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"),
                       F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"),
                       F.col("_metadata.row_index").alias("_index"))
    files = rows.groupBy("_file", "_name").agg((F.max("_index") + 1).alias("_n"))
    earlier = Window.orderBy("_name", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select("_row", (F.col("_start") + F.col("_index")).alias("_place"))


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with mix_position, its place in the files; null if they aren't from files."""
    docs = docs.drop("mix_position")
    if not docs.inputFiles():
        return docs.withColumn("mix_position", F.lit(None).cast("long"))
    return in_files(docs).select("_row.*", F.col("_place").alias("mix_position"))


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", one_of_each_group),
          ("mixing", mix_sources), ("byte-level BPE", encode_texts)]

#: SQL can express neither the network nor the merges; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each over all rows that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
