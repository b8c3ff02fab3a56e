"""Shards of consecutive rows, kept in a bucketed table so that answers by shard are joined without moving them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import checkpoint_path
from . import words as W

#: UTF-8 bytes of text in a shard (a longer text is a shard of its own).
SHARD_BYTES = 1 << 24


def cut(batches: Iterator[pa.RecordBatch], text: int, size: int = SHARD_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows) of about ``size`` bytes in column ``text`` each; the shard's number is unique and the same in a retry."""
    context = TaskContext.get()
    base, k = (context.partitionId() if context else 0) << 32, 0
    for batch in batches:
        ends = W.bytes_of(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield base + k, batch.slice(at, to - at)
            at, k = to, k + 1


def one(values: pa.Array) -> pa.ListArray:
    """A list array of one row that holds all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder in as many buckets by ``shard`` as shuffles have partitions.

    Joined or grouped by shard with a shuffled table, it is read bucket by bucket and not shuffled.
    """
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard") \
        .option("compression", "zstd").option("path", checkpoint_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def with_answers(shards: DataFrame, answers: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``make`` returns for each shard from its row and its rows among ``answers``."""
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(make, schema)
