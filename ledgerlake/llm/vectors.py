"""Vector columns as numpy arrays, and chunked groups of queries and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def meet(rows: DataFrame, queries: DataFrame, key: list[str], row_chunk: int, query_chunk: int,
         carried: tuple[str, ...] = ()) -> DataFrame:
    """Rows and queries of each key together, in groups of bounded size.

    Both have the columns ``key``, id, vector and ``carried``; queries may have
    a floor (the score to beat).
    A key's rows are split over ceil(n / row_chunk) chunks and its queries over
    ceil(m / query_chunk), by id and vector, so that an id with many vectors is
    split too; each pair of chunks is one group, identified by the added column
    _group.  Column _query tells the sides apart.  Keys
    without queries or without rows are left out.  The table of sizes has one
    row per key.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")) \
        .join(queries.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")), key) \
        .select(*key, F.ceil(F.col("_n") / row_chunk).cast("int").alias("_rows"),
                F.ceil(F.col("_m") / query_chunk).cast("int").alias("_queries"))
    chunk = F.xxhash64("id", "vector", F.lit(7))

    def side(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other")
        placed = df.join(sizes, key).withColumn("_own", F.pmod(chunk, F.col(own)).cast("int")).select("*", every)
        pair = ("_other", "_own") if query else ("_own", "_other")
        return placed.select(F.struct(*key, *[F.col(c).alias(f"_{i}") for i, c in enumerate(pair)]).alias("_group"),
                             F.lit(query).alias("_query"), "id", "vector", "floor", *carried)

    if "floor" not in queries.columns:
        queries = queries.withColumn("floor", F.lit(None).cast("double"))
    return side(rows.withColumn("floor", F.lit(None).cast("double")), "_rows", "_queries", False) \
        .unionByName(side(queries, "_queries", "_rows", True))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k rows of highest score per query_id, ties to the smaller vec_id, ranked from 1.

    Repeated ids count once.  A list that was cut at k before has to hold each id
    once as well, or copies take others' places.
    """
    from pyspark.sql.window import Window
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
