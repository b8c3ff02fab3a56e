"""Scans of stored tables and catalog registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The raw tables the driver ships under every scale-factor folder.
RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, data_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Scan one parquet table; a fixed schema skips footer inference."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def stream_path(path: str) -> str:
    """``path`` of one file or of a folder of part files, as a file stream takes either: a pattern that only it matches.

    A pattern is listed anew for every micro-batch; a plain path would have to be
    a folder.
    """
    return path if any(ch in path.rsplit("/", 1)[-1] for ch in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def stream_table(spark: SparkSession, data_dir: str, name: str, schema: StructType) -> DataFrame:
    """One parquet table as a file stream."""
    return spark.readStream.schema(schema).parquet(stream_path(f"{data_dir.rstrip('/')}/{name}.parquet"))


def register_all(spark: SparkSession, data_dir: str, names=RAW_TABLES) -> list[str]:
    """Expose every table as a temp view so SQL users see one catalog."""
    for n in names:
        read_table(spark, data_dir, n).createOrReplaceTempView(n)
    return list(names)


def read_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A managed table, or an empty frame of the right shape on first run."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def read_path_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S5 for path-addressed tables (no metastore needed)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # path absent on first run
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise

