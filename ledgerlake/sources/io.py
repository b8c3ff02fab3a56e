"""Table maintenance, guarded reads, result export.

Writes are whole-job file commits (one job, not 100 rows per commit); keyed
inserts and purges are anti-joins.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

from ..functions.common import fmt_iso


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a result to a table folder (atomic per job)."""
    df.write.mode("append").format(fmt).save(path)


def seed_if_empty(df: DataFrame, target: DataFrame, path: str) -> bool:
    """Write ``df`` only when the target has no rows; returns whether it wrote."""
    if not target.isEmpty():
        return False
    append(df, path)
    return True


def missing_rows(df: DataFrame, target: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row of ``df`` per key that ``target`` lacks: the first by ``order`` (default: by all other columns)."""
    by = order or [c for c in df.columns if c != key] or [key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*by)).alias("_row")).select("_row.*")
    return first.join(target.select(key), key, "left_anti").select(df.columns)


def insert_missing(df: DataFrame, target: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``missing_rows`` (the get-or-create pattern for a whole batch).

    To extend a stored table, append ``missing_rows`` to it instead of writing all of this.
    """
    return target.unionByName(missing_rows(df, target, key, order), allowMissingColumns=True)


def purge_sessions(table: DataFrame, session_ids: DataFrame, key: str = "session_id") -> DataFrame:
    """The table without the given sessions (write the result back to purge)."""
    return table.join(session_ids.select(key).distinct(), key, "left_anti")


def purge_all(tables: dict[str, DataFrame], session_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Purge every telemetry table, or only the given sessions from each of them."""
    if session_ids is None:
        return {name: df.limit(0) for name, df in tables.items()}
    return {name: purge_sessions(df, session_ids) for name, df in tables.items()}


def with_empty_vector(df: DataFrame, col: str = "embeddings") -> DataFrame:
    """A copy of the table with an empty vector column (CTAS + ALTER ADD)."""
    return df.withColumn(col, F.lit(None).cast("array<float>"))


def describe_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """One row per column: table, column, type, nullable, position, and the table's row count.

    The row count is a scalar subquery (one aggregate job), not a driver loop.
    """
    cols = [(f.name, f.dataType.simpleString(), f.nullable, i + 1) for i, f in enumerate(df.schema.fields)]
    meta = spark.createDataFrame(cols, "column_name string, data_type string, is_nullable boolean, ordinal bigint")
    n = df.select(F.count(F.lit(1))).scalar()
    return meta.select(F.lit(name).alias("table_name"), "*", n.alias("row_count"))


# Statements a guarded read refuses, and the limit bounds.
PROHIBITED = ["DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE"]
LIMIT_MIN, LIMIT_MAX, LIMIT_DEFAULT = 1, 1000, 100


class GuardError(ValueError):
    pass


def guarded_sql(spark: SparkSession, query: str, limit: int = LIMIT_DEFAULT) -> DataFrame:
    """Run a read-only query with at most ``limit`` rows (clamped to 1..1000).

    Must start with SELECT; any prohibited keyword as a token rejects it.  The limit is always applied with
    ``.limit`` (D18), not by text inspection.
    """
    upper = query.strip().upper()
    if not upper.startswith("SELECT"):
        raise GuardError("Only SELECT queries are allowed.")
    tokens = set(re.split(r"[\s;()]", upper))
    for kw in PROHIBITED:
        if kw in tokens:
            raise GuardError(f"Query contains prohibited keyword: {kw}")
    n = min(max(LIMIT_MIN, int(limit)), LIMIT_MAX)
    return spark.sql(query).limit(n)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; timestamps ISO-8601, decimals as strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = fmt_iso(c)                       # isoformat: fraction only when non-zero
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def orphan_transactions(tx: DataFrame, acc: DataFrame) -> DataFrame:
    """Transaction account ids (either side) missing from accounts."""
    ids = acc.select(F.col("account_id").alias("_a"))
    out = None
    for side in ("from_account_id", "to_account_id"):
        t = tx.filter(F.col(side).isNotNull()).select("id", F.lit(side).alias("side"), F.col(side).alias("account_id"))
        o = t.join(ids, t["account_id"] == ids["_a"], "left_anti")
        out = o if out is None else out.unionByName(o)
    return out
