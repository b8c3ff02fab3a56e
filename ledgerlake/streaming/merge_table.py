"""A table of the latest row per key, fed by micro-batches and compacted in the background.

Layout below one folder::

    data/part=delta-<job>-<batch>/bucket=<b>/   what a micro-batch wrote (overwritten if it is replayed)
    data/part=snapshot-<name>/bucket=<b>/       one row per key
    manifest/<version>/                         the snapshot to read, and the deltas that are in it

Readers take the newest manifest's snapshot and the deltas that it doesn't
name.  A compaction writes a new snapshot and then a new manifest, which becomes
visible by one rename; until then, and after a crash, the old one holds.  The
merge of an update is idempotent, so a delta may be in the snapshot and read
again.  Old files are deleted by ``vacuum`` only, one manifest later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import latest_by


@dataclass(frozen=True)
class MergeTable:
    """``path`` holds the table, ``key`` names its rows and the largest ``order`` wins."""

    spark: SparkSession
    path: str
    key: str
    order: str
    buckets: int = 16

    # ------------------------------------------------------------ writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def write_delta(self, rows: DataFrame, epoch: str) -> None:
        """The updates of one micro-batch; of several for a key the latest, so a hot key is one row per batch."""
        latest_by(rows, self.key, self.order).withColumn("bucket", self._bucket()) \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/part=delta-{epoch}")

    # ------------------------------------------------------------ reading

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        """Folders that a finished write has left."""
        fs, p = self._fs(f"{self.path}/{folder}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(path(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def parts(self, kind: str) -> list[str]:
        """The committed deltas or snapshots (``kind``) by name."""
        return [n.removeprefix("part=") for n in self._names("data") if n.startswith(f"part={kind}-")]

    def _scan(self, names: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/data") \
            .parquet(*[f"{self.path}/data/part={n}" for n in names]).drop("part")

    def manifest(self, version: str | None = None) -> dict:
        """version, snapshot (None: no one yet) and folded (the deltas in it) of the newest manifest, or of ``version``."""
        found = self._names("manifest")
        version = version or (found[-1] if found else None)
        if version is None:
            return {"version": 0, "snapshot": None, "folded": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}").first()[0])

    def open_deltas(self, manifest: dict | None = None) -> list[str]:
        """Committed deltas that the manifest's snapshot doesn't hold."""
        folded = set((manifest or self.manifest())["folded"])
        return [n for n in self.parts("delta") if n not in folded]

    def _merged(self, manifest: dict, deltas: list[str]) -> DataFrame | None:
        names = ([manifest["snapshot"]] if manifest["snapshot"] else []) + deltas
        if not names:
            return None
        rows = self._scan(names)
        return rows if not deltas else latest_by(rows.drop("bucket"), self.key, self.order).withColumn("bucket", self._bucket())

    def read(self) -> DataFrame | None:
        """The latest row of every key; None before the first delta."""
        now = self.manifest()
        rows = self._merged(now, self.open_deltas(now))
        return None if rows is None else rows.drop("bucket")

    def lookup(self, values: list) -> DataFrame | None:
        """The rows of some keys, from the files of their buckets only."""
        now = self.manifest()
        names = ([now["snapshot"]] if now["snapshot"] else []) + self.open_deltas(now)
        if not names:
            return None
        rows = self._scan(names)
        wanted = self.spark.createDataFrame([(v,) for v in values], f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}")
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]      # of the given values
        rows = rows.where(F.col("bucket").isin(buckets)).drop("bucket")
        return latest_by(rows.join(wanted, self.key, "left_semi"), self.key, self.order)

    # ------------------------------------------------------------ compaction

    def write_snapshot(self) -> dict | None:
        """First step: a new snapshot beside the old one, which nobody reads yet; None if there is nothing new."""
        now = self.manifest()
        deltas = self.open_deltas(now)
        if not deltas:
            return None
        name = f"snapshot-{uuid.uuid4().hex}"
        self._merged(now, deltas).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/part={name}")
        left = set(self.parts("delta"))
        return {"version": now["version"] + 1, "snapshot": name, "folded": sorted(left & {*now["folded"], *deltas})}

    def publish(self, manifest: dict) -> None:
        """Second step: the new manifest appears as a whole; fails if another compaction was faster."""
        draft = f"{self.path}/draft/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(draft)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs, folder = self._fs(f"{self.path}/manifest")
        fs.mkdirs(folder)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(path(draft), path(f"{self.path}/manifest/{manifest['version']:012d}"), plain)

    def compact(self) -> bool:
        """Fold the open deltas into a new snapshot; whether there were any."""
        manifest = self.write_snapshot()
        if manifest:
            self.publish(manifest)
        return manifest is not None

    def vacuum(self) -> None:
        """Delete what neither the newest manifest nor the one before it needs."""
        versions = self._names("manifest")
        kept = [self.manifest(v) for v in versions[-2:]]
        if len(kept) < 2:
            return
        snapshots = {m["snapshot"] for m in kept}
        gone = [f"data/part={n}" for n in set.intersection(*[set(m["folded"]) for m in kept])]
        gone += [f"data/part={n}" for n in self.parts("snapshot") if n not in snapshots]
        gone += [f"manifest/{v}" for v in versions[:-2]]
        for name in gone:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
