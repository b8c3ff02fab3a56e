"""The running state of every session, as a keyed stateful stream.

Messages are folded per Arrow batch to one row per session and agent before they
are shuffled, so a session with a large part of all messages sends a few rows
per task.  The state of a session is its message count, its first and last time
and, per agent, when it was first seen; all of that merges in any order, so the
result doesn't depend on how the messages are cut into micro-batches.  An
event-time timer drops the state of a session that has been idle for a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .merge_table import MergeTable

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionState(StatefulProcessor):
    """State of one session: totals, and each agent with the place (time, trace, step) where it was first seen."""

    def __init__(self, idle_ms: int, trace_type: str):
        self.idle_ms, self.trace_type = idle_ms, trace_type

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, created long, updated long, agents array<struct<"
                                           f"at: long, trace: {self.trace_type}, step: long, agent: string>>")

    def handleInputRows(self, key, rows, timerValues):
        n, created, updated, agents = self.totals.get() or (0, None, None, [])
        first, before = {a[3]: tuple(a[:3]) for a in agents}, updated
        for r in rows:
            n += r.n
            created = r.created if created is None else min(created, r.created)
            updated = r.updated if updated is None else max(updated, r.updated)
            if r.agent is not None:
                first[r.agent] = min(first.get(r.agent, (r.at, r.trace, r.step)), (r.at, r.trace, r.step))
        seen = sorted((*place, agent) for agent, place in first.items())
        self.totals.update((n, created, updated, seen))
        if updated != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.idle_ms)
            self.handle.registerTimer(updated // 1000 + self.idle_ms)
        yield Row(session_id=key[0], agents=[s[3] for s in seen], n=n, created=created, updated=updated)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.totals.clear()
        return iter([])

    def close(self) -> None:
        pass


def _fold(frames):
    """One row per session and agent of each Arrow batch: counts, times and the agent's first place."""
    for f in frames:
        groups = f.sort_values(["at", "trace", "step"]).groupby(["session_id", "agent"], dropna=False, sort=False)
        yield groups.agg(at=("at", "first"), trace=("trace", "first"), step=("step", "first"), n=("at", "size"),
                         created=("at", "min"), updated=("at", "max")).reset_index()


def running_sessions(msgs: DataFrame, idle: str = "30 days", delay: str = "1 day") -> DataFrame:
    """In update mode the sessions that a micro-batch touches, with all that is known of them.

    ``msgs``: session_id, agent_name (null: no agent's message), trace_id,
    routing_step and trace_end (TIMESTAMP).  Agents stand in first-seen order
    (time, trace, step).  Messages more than ``delay`` behind the latest are
    dropped, and a session without messages for ``idle`` of event time is
    forgotten: a later message opens it anew.  Messages without a session or a
    time count nowhere.
    """
    key, trace = (msgs.schema[c].dataType.simpleString() for c in ("session_id", "trace_id"))
    rows = msgs.where("session_id is not null and trace_end is not null").select(
        "session_id", F.col("agent_name").alias("agent"), F.unix_micros("trace_end").alias("at"),
        F.col("trace_id").alias("trace"), F.col("routing_step").cast("long").alias("step"))
    folded = rows.mapInPandas(_fold, f"session_id {key}, agent string, at long, trace {trace}, step long, n long, created long, updated long")
    state = folded.withColumn("seen", F.timestamp_micros("updated")).withWatermark("seen", delay).groupBy("session_id") \
        .transformWithState(SessionState(_millis(idle), trace),
                                    f"session_id {key}, agents array<string>, n long, created long, updated long", "update", "eventTime")
    return state.select(
        "session_id", F.array_join("agents", ",").alias("agent_names_used"), F.size("agents").cast("bigint").alias("total_agents_used"),
        F.col("n").alias("n_messages"), F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"),
        F.floor((F.col("updated") - F.col("created")) / 1000).cast("bigint").alias("session_duration_ms"),
        F.expr("floor(updated / 1000000) - floor(created / 1000000)").cast("bigint").alias("sess_duration"))


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def sessions_table(spark, path: str) -> MergeTable:
    """The latest emitted row per session; a session's message count only grows."""
    return MergeTable(spark, path, "session_id", "n_messages")


def run_sessions(msgs: DataFrame, path: str, checkpoint: str | None = None, idle: str = "30 days", delay: str = "1 day") -> StreamingQuery:
    """Keep ``sessions_table(path)`` up to date with the stream ``msgs``; run again, it takes only new messages."""
    from .events import batch_name, default_checkpoint
    spark = msgs.sparkSession
    table, ck = sessions_table(spark, path), checkpoint or default_checkpoint(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:        # a query keeps the settings that it was started with
        return running_sessions(msgs, idle, delay).writeStream.outputMode("update").option("checkpointLocation", ck) \
            .foreachBatch(lambda batch, epoch: table.write_delta(batch, batch_name(ck, epoch))).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
