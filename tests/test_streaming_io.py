"""Streaming jobs equal their batch twins; incremental jobs are idempotent; I/O helpers."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import evaluation as EV
from ledgerlake.operators import safety as S
from ledgerlake.operators import telemetry as T
from ledgerlake.session import checkpoint_path
from ledgerlake.sources import fixtures as X
from ledgerlake.sources import io as IO
from ledgerlake.sources.tables import read_table
from ledgerlake.streaming import events as SE
from ledgerlake.streaming import sessions as RS
from ledgerlake.streaming.merge_table import MergeTable


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_windowed_stream_equals_batch(spark, small_dir):
    stream = SE.read_events_stream(spark, small_dir, max_files_per_trigger=1)
    got = SE.run_to_table(SE.events_by_category_windowed(stream), "complete")
    batch_src = SE.to_agentic(read_table(spark, small_dir, "events"))
    want = SE.events_by_category_windowed(batch_src)
    assert _rows(got) == _rows(want)


def test_landed_events_equal_source(spark, small_dir):
    out = tempfile.mkdtemp(prefix="ll-land-")
    ck = checkpoint_path(spark, f"land-ck-{uuid.uuid4().hex}")
    SE.land_events(SE.read_events_stream(spark, small_dir), out + "/events", ck).awaitTermination()
    landed = spark.read.parquet(out + "/events")
    n = read_table(spark, small_dir, "events").count()
    assert landed.count() == n
    # a second run from the same checkpoint finds no new files and adds nothing
    SE.land_events(SE.read_events_stream(spark, small_dir), out + "/events", ck).awaitTermination()
    assert spark.read.parquet(out + "/events").count() == n
    assert S.allowed_events(landed).count() > 0


def test_tool_usage_upsert_is_idempotent(spark, small_dir):
    tu = X.tool_usage(spark, small_dir).select("tool_call_id", "tool_output", "tokens_used")
    log = checkpoint_path(spark, f"tool-log-{uuid.uuid4().hex}")
    updates = tu.withColumn("logged_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # the update stream is a file stream over a folder of batches
    src = tempfile.mkdtemp(prefix="ll-upd-")
    updates.write.mode("overwrite").parquet(src + "/b1")
    changed = updates.filter(F.col("tool_call_id") % 2 == 0).withColumn("tool_output", F.lit("v2")) \
        .withColumn("logged_at", F.lit("2024-01-01 01:00:00").cast("timestamp"))
    changed.write.mode("overwrite").parquet(src + "/b2")
    stream = spark.readStream.schema(updates.schema).option("recursiveFileLookup", "true").parquet(src)
    ck = checkpoint_path(spark, f"tool-ck-{uuid.uuid4().hex}")
    SE.upsert_tool_usage(stream, log, ck).awaitTermination()
    first = _rows(SE.current_tool_usage(spark, log))
    SE.upsert_tool_usage(spark.readStream.schema(updates.schema).option("recursiveFileLookup", "true").parquet(src),
                         log, ck).awaitTermination()
    assert _rows(SE.current_tool_usage(spark, log)) == first
    cur = {r["tool_call_id"]: r["tool_output"] for r in SE.current_tool_usage(spark, log).collect()}
    assert all((v == "v2") == (k % 2 == 0) for k, v in cur.items())


def test_score_increment_adds_nothing_on_rerun(spark, small_dir):
    pairs = EV.qa_pairs(X.chat_history(spark, small_dir))
    path = checkpoint_path(spark, f"scores-{uuid.uuid4().hex}")
    n1 = EV.score_increment(pairs, path, "r1")
    n2 = EV.score_increment(pairs, path, "r2")
    assert n1 == pairs.select("agent_trace_id").distinct().count() or n1 == pairs.count()
    assert n2 == 0
    assert spark.read.parquet(path).count() == n1


def test_session_state_stream_equals_batch_stats(spark, small_dir):
    import __spark_entry__ as ep
    got = ep.queries()["r10_session_state_stream"](spark, small_dir)
    ch = X.chat_history(spark, small_dir)
    want = ch.groupBy("session_id").agg(F.countDistinct("agent_name").alias("a"), F.count(F.lit(1)).alias("n"))
    assert _rows(got.select("session_id", "total_agents_used", "n_messages")) == _rows(want)


def test_streams_read_tables_of_several_files(spark, small_dir, tmp_path):
    import __spark_entry__ as ep
    for name in ("conversations", "events"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("r10_session_state_stream", "r3s_events_by_category_stream"):
        got = ep.queries()[name](spark, str(tmp_path))
        assert _rows(got) == _rows(ep.queries()[name](spark, small_dir))


def test_insert_missing_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1)], "name string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "name string, v int")
    once = IO.insert_missing(new, target, "name")
    twice = IO.insert_missing(new, once, "name")
    assert sorted(r["name"] for r in once.collect()) == ["a", "b"]
    assert _rows(once) == [("a", 1), ("b", 2)] and _rows(once) == _rows(twice)
    assert _rows(IO.missing_rows(new.withColumn("w", -F.col("v")), target, "name", ["w"])) == [("b", 3, -3)]


def test_dense_chunk_ids_are_contiguous(spark, small_dir):
    from ledgerlake.operators import documents as D
    chunks = D.chunk_documents(X.chunk_source(spark, small_dir))
    existing = spark.createDataFrame([(41,)], "id bigint")
    ids = D.write_chunks(chunks, existing)
    n = chunks.count()
    got = [r["id"] for r in ids.orderBy("doc_id", "chunk_no").collect()]
    assert got == list(range(42, 42 + n))
    whole = D.ingest_documents(X.chunk_source(spark, small_dir), existing)
    columns = ["id", "doc_id", "chunk_no", "source_pdf", "chunk_text"]
    assert _rows(whole.select(columns)) == _rows(ids.select(columns))


def test_describe_table_and_json_rows(spark, small_dir):
    tx = X.transactions(spark, small_dir)
    desc = IO.describe_table(spark, tx, "transactions").collect()
    assert [r["column_name"] for r in desc] == tx.columns and desc[0]["row_count"] == tx.count()
    js = IO.to_json_rows(tx.limit(1)).first()["json"]
    assert '"amount":"' in js and "T00:00:00" in js


def test_trace_fan_out_skips_replayed_history(spark):
    import json
    msgs1 = [{"__class__": "HumanMessage", "id": "h0", "content": "old"},
             {"__class__": "AIMessage", "id": "a0", "content": "old answer"},
             {"__class__": "HumanMessage", "id": "h1", "content": "new"},
             {"__class__": "AIMessage", "id": "a1", "content": "route", "response_metadata": {"finish_reason": "stop"}}]
    msgs2 = [{"__class__": "HumanMessage", "id": "h0", "content": "old"},
             {"__class__": "AIMessage", "id": "a0", "content": "old answer"},
             {"__class__": "AIMessage", "id": "t1", "content": "",
              "response_metadata": {"finish_reason": "tool_calls"},
              "additional_kwargs": {"tool_calls": [{"id": "c1", "function": {"name": "get_user_accounts_for_current_user",
                                                                              "arguments": "{}"}}]}},
             {"__class__": "ToolMessage", "id": "r1", "name": "get_user_accounts", "tool_call_id": "c1",
              "content": '{"message": "Error: boom"}'}]
    raw = spark.createDataFrame([(1, 7, 9, ["coordinator", "account_agent"], [0.5, 1.25],
                                  [json.dumps(msgs1), json.dumps(msgs2)])],
                                "trace_id bigint, session_id bigint, user_id bigint, nodes_list array<string>, "
                                "event_times array<double>, messages array<string>")
    out = T.explode_trace(raw)
    hist = {(r["message_id"], r["message_type"], r["routing_step"]) for r in out["chat_history"].collect()}
    assert hist == {("h1", "human", 0), ("a1", "ai", 1), ("t1", "tool_call", 2), ("r1", "tool_result", 2)}
    hops = [(r["step_order"], r["from_agent"], r["current_agent"], r["execution_duration_ms"])
            for r in out["agent_traces"].orderBy("step_order").collect()]
    assert hops == [(1, "system", "coordinator", 500), (2, "coordinator", "account_agent", 1250)]
    tu = out["tool_usage"].first()
    assert (tu["tool_name"], tu["status"], tu["tool_message"]) == ("get_user_accounts", "Errored", "Error: boom")


def test_widget_refresh_writes_the_query_points(spark, small_dir):
    import json
    from ledgerlake.operators import refresh as R
    from ledgerlake.operators import widgets as W
    widgets, tx, acc = X.ai_widgets(spark, small_dir), X.transactions(spark, small_dir), X.accounts(spark, small_dir)
    out = R.refresh_widgets(widgets, tx, acc, X.BANK_AS_OF).checkpoint()
    assert out.count() == widgets.count()
    assert out.filter(F.col("status") == "refreshed").count() == widgets.filter(F.col("data_mode") == "dynamic").count()
    static = out.filter(F.col("status") == "static").join(widgets.select("widget_id", F.col("config").alias("c0")),
                                                          "widget_id")
    assert static.filter(F.col("config") != F.col("c0")).count() == 0
    rows = out.filter((F.col("query_type") == "spending_by_category") & (F.col("status") == "refreshed")).collect()
    for r in rows[:20]:
        cfg = json.loads(r["config"])
        assert cfg["title"] == "spending_by_category widget" and cfg["customProps"]["colors"] == ["#3B82F6"]
        data = cfg["customProps"]["data"]
        assert len(data) == r["n_points"]
        want = W.run_query("spending_by_category", tx, acc, X.BANK_AS_OF, r["time_range"]) \
            .filter(F.col("user_id") == r["user_id"]).collect()
        assert sorted((p["name"], p["value"]) for p in data) == sorted((w["name"], w["value"]) for w in want)
        assert [p["value"] for p in data] == sorted((p["value"] for p in data), reverse=True)


def test_command_line_lists_and_explains(spark, small_dir, capsys):
    from ledgerlake.__main__ import main
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.split("\n")
    assert any(line.startswith("a1_spending_by_category (oracle)") for line in listed)
    assert main(["explain", "a5_top_merchants", "--data", small_dir]) == 0
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_trace_fan_out_stream_equals_batch(spark, small_dir):
    from ledgerlake.plans.q_misc import raw_traces
    raw = raw_traces(spark, small_dir)
    src = checkpoint_path(spark, f"raw-{uuid.uuid4().hex}")
    raw.write.parquet(src)
    out = checkpoint_path(spark, f"fan-{uuid.uuid4().hex}")
    SE.explode_trace_stream(spark.readStream.schema(raw.schema).parquet(src), out).awaitTermination()
    want = T.explode_trace(raw)
    for name in ("chat_history", "agent_traces"):
        got = spark.read.parquet(f"{out}/{name}").drop("epoch")
        assert _rows(got.select(*sorted(got.columns))) == _rows(want[name].select(*sorted(got.columns)))


def test_retention_prunes_landed_partitions(spark, small_dir):
    out = checkpoint_path(spark, f"landed-{uuid.uuid4().hex}")
    SE.land_events(SE.read_events_stream(spark, small_dir), out).awaitTermination()
    landed = spark.read.parquet(out)
    as_of = datetime(2024, 1, 30)
    kept = S.retain(landed, as_of)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan or "event_date" in plan.split("PartitionFilters")[1][:200]
    want = landed.filter((F.col("timestamp") > F.lit(datetime(2024, 1, 29)).cast("timestamp")) &
                         (F.col("timestamp") <= F.lit(as_of).cast("timestamp"))).count()
    assert kept.count() == want


def test_streams_run_again_take_new_files_once(spark, small_dir):
    """Run, add files, run again without further arguments: every row exactly once, early and late ones."""
    events = read_table(spark, small_dir, "events")
    src = checkpoint_path(spark, f"again-src-{uuid.uuid4().hex}")
    out = checkpoint_path(spark, f"again-out-{uuid.uuid4().hex}")
    half = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    for k, part in enumerate(half):
        part.write.parquet(f"{src}/b{k}")

        def stream():
            raw = spark.readStream.schema(SE.RAW_EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(src)
            return SE.to_agentic(raw)
        SE.land_events(stream(), f"{out}/events").awaitTermination()
        got = SE.run_to_table(stream(), "append", f"{out}/table")
        counted = SE.run_to_table(SE.events_by_category_windowed(stream()), "complete", f"{out}/windows")
    assert spark.read.parquet(f"{out}/events").count() == events.count() == got.count()
    assert _rows(got.select("trace_id")) == _rows(events.select(F.col("event_id").alias("trace_id")))
    assert _rows(counted) == _rows(SE.events_by_category_windowed(SE.to_agentic(events)))


def test_late_tool_updates_are_kept_across_runs(spark):
    src = checkpoint_path(spark, f"late-src-{uuid.uuid4().hex}")
    log = checkpoint_path(spark, f"late-log-{uuid.uuid4().hex}")
    schema = "tool_call_id bigint, tool_output string, tokens_used int, logged_at timestamp"
    for k, (call, text, at) in enumerate([(1, "a", "2024-01-05"), (2, "late", "2024-01-01"), (1, "b", "2024-01-06"), (1, "old", "2024-01-02")]):
        spark.createDataFrame([(call, text, k, datetime.fromisoformat(at))], schema).write.parquet(f"{src}/b{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        SE.upsert_tool_usage(stream, log).awaitTermination()
    assert _rows(SE.current_tool_usage(spark, log).select("tool_call_id", "tool_output")) == [(1, "b"), (2, "late")]


def test_scores_do_not_depend_on_the_increments(spark, small_dir):
    """A scorer that looks at the history gives the same scores in one run and in several."""
    def scorer(pdf):
        out = {f: [""] * len(pdf) for f in EV.SCORE_FIELDS}
        for m in EV.METRICS:
            out[m] = [float(len(h)) for h in pdf["conversation_history"]]
            out[f"{m}_threshold"] = [3.0] * len(pdf)
        return pd.DataFrame(out)
    pairs = EV.qa_pairs(X.chat_history(spark, small_dir))
    # a trace is scored at once; its place in the session is that of its first turn
    first = pairs.groupBy("agent_trace_id").agg(F.min("turn_number").alias("_first"))
    pairs = pairs.join(first, "agent_trace_id")
    cuts = pairs.approxQuantile("_first", [0.4, 0.7], 0.0)
    wanted = None
    for bounds in ([], cuts[:1], cuts):
        path = checkpoint_path(spark, f"incr-{uuid.uuid4().hex}")
        low = None
        for high in [*bounds, None]:
            part = pairs
            if low is not None:
                part = part.filter(F.col("_first") > low)
            if high is not None:
                part = part.filter(F.col("_first") <= high)
            EV.score_increment(part.drop("_first"), path, "r", scorer)
            low = high
        got = _rows(spark.read.parquet(path).select("agent_trace_id", "turn_number", EV.METRICS[0]))
        wanted = wanted or got
        assert got == wanted and max(r[2] for r in got) > 0


def test_trend_points_are_wide_and_complete(spark, small_dir):
    import json
    from ledgerlake.operators import refresh as R
    from ledgerlake.operators import widgets as W
    tx, acc = X.transactions(spark, small_dir), X.accounts(spark, small_dir)
    widgets = X.ai_widgets(spark, small_dir).withColumn("data_mode", F.lit("dynamic"))
    out = R.refresh_widgets(widgets, tx, acc, X.BANK_AS_OF).filter(F.col("query_type") == "category_trend").collect()
    assert out
    for r in out[:20]:
        data = json.loads(r["config"])["customProps"]["data"]
        long = W.run_query("category_trend", tx, acc, X.BANK_AS_OF, r["time_range"]).filter(F.col("user_id") == r["user_id"]).collect()
        want = {}
        for p in long:
            want.setdefault(p["name"], {})[p["category"]] = p["value"]
        months = [m["name"] for m in W.run_query("monthly_trend", tx, acc, X.BANK_AS_OF, r["time_range"])
                  .filter(F.col("user_id") == r["user_id"]).orderBy("month").collect()]
        assert [p.pop("name") for p in data] == months
        assert data == [want.get(m, {}) for m in months]


def test_widget_data_keeps_all_other_members(spark):
    import json
    from ledgerlake.operators import widgets as W
    configs = ['{"a":1.5,"b":null,"customProps":{"height":{"x":[1,"q\\"",true]},"data":[1]},"é":"\\u00e9"}', '{}', '{"customProps":null}',
               "[1]", "no json", None, '{"customProps":{"data":"x","n":12345678901234567890}}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(configs)], "i int, c string")
    got = {r["i"]: r["o"] for r in df.select("i", W.set_widget_data(F.col("c"), F.array(F.lit('{"v":2}'))).alias("o")).collect()}
    for i, c in enumerate(configs[:3] + configs[6:]):
        i = i if i < 3 else 6
        want = json.loads(c)
        want["customProps"] = {**(want.get("customProps") or {}), "data": [{"v": 2}]}
        assert json.loads(got[i]) == want
    assert [got[3], got[4], got[5]] == configs[3:6]


def test_questions_without_rows(spark):
    from ledgerlake.operators import vectors as V
    none = spark.createDataFrame([], "query_id bigint, vec array<float>")
    chunks = spark.createDataFrame([(1, [1.0], "t"), (2, None, "u")], "id bigint, vec array<float>, chunk_text string")
    assert V.rag_context(none, chunks).count() == 0
    one = spark.createDataFrame([(5, [2.0])], "query_id bigint, vec array<float>")
    assert [tuple(r) for r in V.rag_context(one, chunks).collect()] == [(5, 1, V.rag_context(one, chunks).first()["context"])]


# ---------------------------------------------------------------- running sessions (R10), merge table

def _message_batches(spark, small_dir, parts, order="trace_end"):
    """chat_history as message batches in time order, and all of it as a table."""
    msgs = X.chat_messages(read_table(spark, small_dir, "conversations")).checkpoint()
    ids = msgs.select("session_id", "trace_id").orderBy(order, "session_id", "trace_id").collect()
    cut = [ids[len(ids) * k // parts:len(ids) * (k + 1) // parts] for k in range(parts)]
    keys = [spark.createDataFrame([tuple(r) for r in c], "session_id bigint, trace_id bigint") for c in cut]
    return msgs, [msgs.join(k, ["session_id", "trace_id"], "left_semi") for k in keys]


def _batch_sessions(msgs):
    """A25 and A26 of the messages so far, from the batch operators."""
    traces = msgs.filter("agent_name is not null").select("session_id", "trace_id", F.col("routing_step").alias("step_order"),
                                                        F.col("agent_name").alias("current_agent"))
    sessions = msgs.groupBy("session_id").agg(F.lit(1).alias("user_id"), F.min("trace_end").alias("created_at"),
                                             F.max("trace_end").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))
    stats = T.session_stats(traces, sessions).drop("user_id")
    return stats.join(T.session_duration(sessions).select("session_id", "sess_duration"), "session_id") \
        .join(sessions.select("session_id", "n_messages"), "session_id")


@pytest.mark.parametrize("parts,order", [(1, "trace_end"), (2, "trace_id"), (3, "trace_end")])
def test_running_sessions_equal_the_batch_after_every_increment(spark, small_dir, parts, order):
    """By trace_end the increments follow time; by trace_id every session is touched again and again, out of step with time."""
    msgs, batches = _message_batches(spark, small_dir, parts, order)
    src, out = (checkpoint_path(spark, f"sess-{k}-{uuid.uuid4().hex}") for k in ("src", "out"))
    table = RS.sessions_table(spark, out)
    known, so_far = set(), None
    for k, batch in enumerate(batches):
        batch.write.parquet(f"{src}/b{k}")
        stream = spark.readStream.schema(msgs.schema).option("recursiveFileLookup", "true").parquet(src)
        RS.run_sessions(stream, out, idle="3650 days", delay="3650 days").awaitTermination()
        so_far = batch if so_far is None else so_far.unionByName(batch)
        want = _batch_sessions(so_far)
        assert _rows(table.read().select(want.columns)) == _rows(want)
        new = set(table.open_deltas()) - known
        known |= new
        emitted = table._scan(sorted(new)).select("session_id")
        assert _rows(emitted) == _rows(batch.select("session_id").distinct())       # touched sessions, once each


def test_idle_sessions_leave_the_state(spark, small_dir):
    msgs, batches = _message_batches(spark, small_dir, 3)
    src, out = (checkpoint_path(spark, f"idle-{k}-{uuid.uuid4().hex}") for k in ("src", "out"))
    for k, batch in enumerate(batches):
        batch.write.parquet(f"{src}/b{k}")
        stream = spark.readStream.schema(msgs.schema).option("recursiveFileLookup", "true").parquet(src)
        RS.run_sessions(stream, out, idle="2 hours", delay="1 hour").awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "totals").load(SE.default_checkpoint(out))
    ids = {r["key"]["session_id"] for r in held.select("key").collect()}
    last = {r["session_id"]: r["t"] for r in msgs.groupBy("session_id").agg(F.max("trace_end").alias("t")).collect()}
    end = max(last.values())
    assert 0 < len(ids) < len(last) / 2 and all((end - last[i]).total_seconds() <= 3 * 3600 + 60 for i in ids)
    assert RS.sessions_table(spark, out).read().count() == len(last)                # what was emitted stays in the table


def test_a_hot_session_and_messages_without_key(spark):
    rows = [(1 if i % 3 else 2 + i, i, 1, [None, "b", "a"][i % 3 - 1], datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(3000)]
    rows += [(None, 1, 1, "a", datetime(2024, 1, 1)), (7, 1, 1, "a", None)]
    schema = "session_id bigint, trace_id bigint, routing_step bigint, agent_name string, trace_end timestamp"
    src, out = (checkpoint_path(spark, f"hot-{k}-{uuid.uuid4().hex}") for k in ("src", "out"))
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(src)
    RS.run_sessions(spark.readStream.schema(schema).parquet(src), out).awaitTermination()
    hot = RS.sessions_table(spark, out).lookup([1]).first()
    assert (hot["n_messages"], hot["agent_names_used"], hot["sess_duration"]) == (2000, "b", 2998)


def test_merge_table_through_compactions_and_crashes(spark):
    path = checkpoint_path(spark, f"merge-{uuid.uuid4().hex}")
    table = MergeTable(spark, path, "id", "at", buckets=4)
    schema = "id bigint, v string, at bigint"
    assert table.read() is None and not table.compact()

    def want(*batches):
        best = {}
        for r in [x for b in batches for x in b]:
            if r[0] not in best or r[2] > best[r[0]][2]:
                best[r[0]] = r
        return sorted(best.values())

    def got():
        return sorted((r["id"], r["v"], r["at"]) for r in table.read().collect())
    b1 = [(i, f"a{i}", 5) for i in range(40)]
    b2 = [(i, f"b{i}", 9 if i % 2 else 1) for i in range(30, 60)] + [(31, "twice", 10)]
    b3 = [(3, "c", 7)]
    table.write_delta(spark.createDataFrame(b1, schema), "j-0")
    table.write_delta(spark.createDataFrame(b2, schema), "j-1")
    assert got() == want(b1, b2)
    plan = table.write_snapshot()                       # a crash here leaves a snapshot that no manifest names
    assert got() == want(b1, b2) and table.manifest()["snapshot"] is None
    table.write_delta(spark.createDataFrame(b3, schema), "j-2")      # comes in during the compaction
    table.publish(plan)
    assert got() == want(b1, b2, b3) and table.open_deltas() == ["delta-j-2"]
    with pytest.raises(Exception, match="exist"):       # a slower compaction doesn't replace a newer manifest
        table.publish(plan)
    table.write_delta(spark.createDataFrame(b1, schema), "j-0")      # a batch replayed after it was folded
    assert got() == want(b1, b2, b3)
    assert table.compact() and table.open_deltas() == []
    assert got() == want(b1, b2, b3)
    held = table.read().inputFiles()                    # all of them in one snapshot
    assert held and all(f"/part={table.manifest()['snapshot']}/" in f for f in held)
    old = table.parts("snapshot")
    table.vacuum()
    assert got() == want(b1, b2, b3) and len(table.parts("snapshot")) == 2 <= len(old) and "delta-j-1" not in table.parts("delta")
    assert sorted((r["id"], r["v"]) for r in table.lookup([3, 31, 999]).collect()) == [(3, "c"), (31, "twice")]
    # a delta without the marker of a committed write isn't read
    table.write_delta(spark.createDataFrame([(1, "half", 99)], schema), "j-3")
    fs, p = table._fs(f"{path}/data/part=delta-j-3/_SUCCESS")
    fs.delete(p, False)
    assert got() == want(b1, b2, b3)


def test_upserts_with_compaction_on_the_way(spark):
    src, log = (checkpoint_path(spark, f"cmp-{k}-{uuid.uuid4().hex}") for k in ("src", "log"))
    schema = "tool_call_id bigint, tool_output string, tokens_used int, logged_at timestamp"
    for k in range(5):
        rows = [(i, f"v{k}", k, datetime(2024, 1, 1 + (k * 7 + i) % 20)) for i in range(k, 30, 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    SE.upsert_tool_usage(stream, log, compact_every=2).awaitTermination()
    want = T.latest_tool_usage(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(src))
    assert _rows(SE.current_tool_usage(spark, log).select(want.columns)) == _rows(want)
    assert len(SE.tool_usage_table(spark, log).open_deltas()) == 1
