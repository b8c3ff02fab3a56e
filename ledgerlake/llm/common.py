"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_path


#: Rows of an Arrow batch that are worked on at a time, so that long texts take little memory.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Cuts the lineage in a form that survives lost executors, is compressed and
    can be read column by column.  The folder name is fresh for every call.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus`` (null keys: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def add_columns(df: DataFrame, used: list[str], added: T.StructType, make: Callable[..., Iterator],
                keep: list[str] | None = None, rows: int = SLICE) -> DataFrame:
    """Append the columns that ``make`` computes from each Arrow batch.

    ``make`` is called once per task without arguments and returns a function
    from the ``used`` columns of a batch (Arrow arrays) to the ``added`` ones; its
    attribute ``end``, if it has one, is called when the task ends.
    Input columns that bear an added column's name are replaced; ``keep`` names
    the input columns to carry along (default: all of them).  It sees ``rows``
    rows at a time.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c not in added.fieldNames()]
    carried = [f"_{i}" for i in range(len(names))]
    source = df.select(*[F.col(_quoted(c)).alias(a) for c, a in zip(names, carried)],
                       *[F.col(_quoted(c)).alias(f"_u{i}") for i, c in enumerate(used)])
    schema = T.StructType([T.StructField(a, df.schema[c].dataType) for c, a in zip(names, carried)]
                          + list(added.fields))
    n, m = len(names), len(used)
    arrow = to_arrow_schema(T.StructType(list(added.fields)))

    def run(batches):
        step = make()
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            new = step(*[batch.column(n + i) for i in range(m)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [x if isinstance(x, pa.Array) else pa.array(x, f.type)
                                                       for x, f in zip(new, arrow)],
                names=carried + arrow.names)
        getattr(step, "end", lambda: None)()
        step = new = batch = None
        pa.default_memory_pool().release_unused()         # the worker waits for its next task without what this one held

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for c, a in zip(names, carried)], *added.fieldNames())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
