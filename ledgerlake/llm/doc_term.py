"""Sparse document-term matrix over a dictionary of all words.

Words are maximal runs of bytes other than space and 0x09-0x0D, case-sensitive.
A shard of rows is encoded by its own words first and written in compressed
sparse rows: of each row the words it holds, as numbers, and how often.  The
shards' word lists then meet by word, one row per shard and word whatever the
word's frequency, and every distinct word gets a number of its own.  The numbers
go back to the shards and replace the shard's own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import words as W
from .common import materialize
from .shards import SHARD_BYTES, cut, one, stored, with_answers


def row_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words in order as bytes, the number of each text's first word, and the bytes and offsets of the texts."""
    raw, offsets = W.bytes_of(texts)
    starts, ends, first = W.bounds(raw, offsets)
    solid = ~W._SPACE[raw]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw[solid].tobytes())])
    return words, first, raw, offsets


def compressed_rows(words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Entries of each row, column and count of each entry, and the word of each column."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = max(1, len(coded.dictionary))
    key, count = np.unique(row * width + coded.indices.to_numpy(), return_counts=True) if len(words) else \
        (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.bincount(key // width, minlength=len(first) - 1), key % width, count, coded.dictionary


def shard_rows(docs: DataFrame, keep: list[str], text: str = "text", measure: Callable | None = None,
               measured: dict[str, pa.DataType] | None = None, size: int = SHARD_BYTES) -> DataFrame:
    """Stored shards: shard, rows (the ``keep`` columns and what ``measure`` returns), entries, columns, counts, words.

    Entries, columns (each less the one before) and counts are 32-bit numbers in bytes.

    ``measure`` gets the bytes of a shard's texts and where each begins, and
    returns one array per name in ``measured``.  A null text has no words.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, names)])
    measured = measured or {}
    kept = pa.struct([(k, to_arrow_type(source.schema[k].dataType)) for k in names] + list(measured.items()))

    def run(batches):
        for shard, batch in cut(batches, 0, size):
            words, first, raw, offsets = row_words(batch.column(0))
            entries, columns, counts, vocabulary = compressed_rows(words, first)
            extra = [pa.array(x, t) for x, t in zip(measure(raw, offsets), measured.values())] if measure else []
            rows = pa.StructArray.from_arrays([batch.column(i + 1) for i in range(len(names))] + extra, fields=list(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), one(rows), *[pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (
                    entries, np.diff(columns, prepend=0), counts)], one(vocabulary)],
                names=["shard", "rows", "entries", "columns", "counts", "words"])

    inner = ", ".join([f"{k}: {source.schema[k].dataType.simpleString()}" for k in names]
                      + [f"{c}: {_sql(t)}" for c, t in measured.items()])
    return stored(source.mapInArrow(run, f"shard long, rows array<struct<{inner}>>, entries binary, columns binary, "
                                         "counts binary, words array<binary>"), "terms")


def _sql(kind: pa.DataType) -> str:
    return {pa.int64(): "bigint", pa.bool_(): "boolean"}[kind]


def dictionary(shards: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """shard, column (the shard's own number of a word), id (the word's number in the whole dictionary) and word.

    The word stands on one row of each id only, so ``where("word is not null")``
    is the dictionary.  Ids are dense.  One shuffle, of a row per shard and word,
    sorted by ``hashed``; different words of one hash get different ids.
    """
    def number(batches):
        base, n, last, held = TaskContext.get().partitionId() << 33, 0, None, {}     # held: the last hash's words
        for batch in batches:
            words, hashed = batch.column(0), batch.column(3).to_numpy()
            if not len(words):
                continue
            head = np.r_[hashed[0] != last, hashed[1:] != hashed[:-1]]
            word = np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]
            if (word[1:] & ~head[1:]).any() or (not head[0] and words[0].as_py() not in held):    # two words share a hash
                at, new = np.empty(len(words), np.int64), np.zeros(len(words), bool)
                for i, w in enumerate(words.to_pylist()):
                    held = {} if head[i] else held
                    new[i] = w not in held
                    n += int(new[i])
                    at[i] = held.setdefault(w, n - 1)
            else:
                first = n - 1 if head[0] else held[words[0].as_py()]
                new, at = head, first + np.cumsum(head)
                at[np.cumsum(head) > 0] += n - 1 - first
                n += int(head.sum())
                if head.any():
                    held = {}
                held[words[-1].as_py()] = int(at[-1])
            last = hashed[-1]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(base + at, pa.int64()),
                                              pc.if_else(pa.array(new), words, pa.scalar(None, pa.binary()))],
                                             names=["shard", "column", "i", "word"])

    listed = shards.select(F.posexplode("words").alias("column", "word"), "shard") \
        .select("word", "shard", "column", hashed(F.col("word")).cast("long").alias("hash"))
    rows = materialize(listed.repartition("hash").sortWithinPartitions("hash")
                       .mapInArrow(number, "shard long, column int, i long, word binary"), "dictionary") \
        .withColumn("task", F.shiftright("i", 33))
    tasks = rows.where("word is not null").groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)      # a row per task
    starts = tasks.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "task") \
        .select("shard", "column", (F.col("start") + F.col("i").bitwiseAND((1 << 33) - 1)).alias("id"), "word")


def encoded(shards: DataFrame, ids: DataFrame, make: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list],
            schema: str) -> DataFrame:
    """What ``make`` returns for each shard: from its rows, and in compressed sparse rows the entries of each, their ids and counts."""
    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        entries, columns, counts = (np.frombuffer(mine[c][0].as_py(), "<i4") for c in ("entries", "columns", "counts"))
        number = np.empty(len(found), np.int64)
        number[found["column"].to_numpy()] = found["id"].to_numpy()
        return make(mine["rows"].combine_chunks().flatten(), entries, number[np.cumsum(columns, dtype=np.int64)], counts)

    return with_answers(shards.drop("words"), ids.select("shard", "column", "id"), run, schema)
