"""Ordered numbering within a key that stays distributed when one key is huge.

``row_number() over (partition by key order by ...)`` sends every row of a key
to one task.  ``ordinal_within`` range-partitions by (key, order) instead, so a
hot key spans several partitions; it numbers rows inside each
(partition, key) slice and adds, per key, the row counts of the key's earlier
slices.  Slices are bounded by partition size; the offset table has one row per
(partition, key) slice.  The range-partitioned keys, not the rows, are checkpointed
once so partition ids cannot drift between the two branches of the plan or across
task retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir


def ordinal_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... per ``key`` in ``order`` (``order`` must end in a unique column).

    Only ``key`` and ``order`` are numbered and written; the other columns join
    the numbers by all of them, a key that is hot in none of its parts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [key, *order]
    # The partition id must mean the same slice in both branches below (and after
    # a retry): the range partitioner samples its input, so the partitioned keys
    # are frozen with a reliable checkpoint in the shared checkpoint folder.
    ranged = df.select(*by).repartitionByRange(*by).withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    local = ranged.withColumn("_lr", F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)))
    counts = local.groupBy("_p", key).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", key, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    numbers = local.join(offsets, ["_p", key]).select(*by, (F.col("_o") + F.col("_lr")).cast("bigint").alias(name))
    if set(df.columns) == set(by):
        return numbers.select(*df.columns, name)
    named = numbers.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], name)
    same = [df[c].eqNullSafe(named[f"_b{i}"]) for i, c in enumerate(by)]
    return df.join(named, same, "left").drop(*[f"_b{i}" for i in range(len(by))])
