"""SparkSession helpers.

Library code never creates its own session; it takes the caller's.  The
helpers here are for tests, the bench and the command line, and for reading
cluster settings (checkpoint folder) that jobs must respect.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job assumes.  Timestamps are compared as UTC wall-clock
# values, the same way the DuckDB oracle sees them.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerlake") -> SparkSession:
    """Local session for tests and the bench (never used by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerlake-wh-"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    alone.  A session without it (tests, a bare local run) gets a fresh local
    folder through ``SparkContext.setCheckpointDir``: the setting itself is
    static and cannot be changed on a running session.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current or tempfile.mkdtemp(prefix="ledgerlake-ckpt-"))
    return current or sc.getCheckpointDir()


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def apply_base_conf(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on (time zone, AQE)."""
    for k, v in BASE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    return spark
