"""Incremental answer evaluation.

Question/answer pairs are aligned with a two-key equi-join; a session's pairs
are stored in blocks of turns, and a pair's prior turns are those of the earlier
blocks and of its own, joined by session and block number.  The default scorer is built from Spark expressions (word
overlap, repetition, length), so scoring stays inside whole-stage codegen; a
Python scorer can be plugged in and runs per Arrow batch via ``mapInPandas``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_path
from .telemetry import conversation_messages

# The four metrics, pass threshold and run labels of the reference.
METRICS = ["intent_resolution", "relevance", "coherence", "fluency"]
THRESHOLD = 3.0
METHOD = "offline_expression_scorer"
WORD_SPLIT = "[ \t\n\r]+"   # explicit class: identical in Java regex and RE2

#: Turns of a session that are stored together.
BLOCK_TURNS = 32

PAIR_COLUMNS = ["agent_trace_id", "session_id", "user_id", "agent_id", "user_question", "agent_answer",
                "turn_number", "invoked_tool_name", "response_time_ms", "model_name", "total_tokens",
                "completion_tokens", "prompt_tokens", "trace_end"]

SCORE_FIELDS = [f"{m}{s}" for m in METRICS for s in ("", "_reason", "_result", "_threshold")] + ["evaluation_error"]


def qa_pairs(ch: DataFrame) -> DataFrame:
    """Human question joined to ai answer on (trace_id, session_id); both texts non-null."""
    from .telemetry import turn_number
    told = turn_number(conversation_messages(ch)).filter(F.col("content").isNotNull())
    asked = told.filter(F.col("message_type") == "human").select(
        "trace_id", "session_id", "user_id", "agent_id", "turn_number", "trace_end", F.col("content").alias("user_question"))
    answered = told.filter(F.col("message_type") == "ai").select(
        "trace_id", "session_id", "response_time_ms", "model_name", "total_tokens", "completion_tokens", "prompt_tokens",
        F.col("content").alias("agent_answer"), F.col("tool_name").alias("invoked_tool_name"))
    return asked.join(answered, ["trace_id", "session_id"]).withColumnRenamed("trace_id", "agent_trace_id").select(*PAIR_COLUMNS)


def history_blocks(pairs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A session's pairs cut into blocks of ``block_turns`` turns, each written once: session_id, block, members.

    ``members`` holds the block's pairs (structs of all their columns) in the
    order of turn, question and answer.  A block is bounded by its turns, so a
    session with a third of all pairs lies in many rows and tasks.
    """
    spark = pairs.sparkSession
    path = checkpoint_path(spark, f"history-{uuid.uuid4().hex}")
    member = F.struct(F.col("turn_number").alias("turn"), F.col("user_question").alias("question"),
                      F.col("agent_answer").alias("answer"), F.struct(*pairs.columns).alias("_pair"))
    pairs.groupBy("session_id", F.floor(F.col("turn_number") / block_turns).alias("block")) \
        .agg(F.array_sort(F.collect_list(member)).alias("members")).write.parquet(path)
    return spark.read.parquet(path)


def prior_turns(blocks: DataFrame) -> DataFrame:
    """For every block with earlier ones in its session, their turns in order: session_id, block, prior.

    A block refers to the earlier blocks by number; each reference fetches one
    block by (session, number), so no task holds more of a session than one
    block's history, which is an output value.
    """
    wanted = blocks.filter(F.col("block") > 0).select(
        "session_id", F.col("block").alias("_for"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("block"))
    kept = blocks.select(F.col("session_id").alias("_session"), F.col("block").alias("_block"), _turns(F.col("members")).alias("_turns"))
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("block") == F.col("_block"))
    return wanted.join(kept, same).groupBy("session_id", F.col("_for").alias("block")) \
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_turns"))), lambda x: x["_turns"])).alias("prior"))


def _turns(members: Column) -> Column:
    return F.transform(members, lambda m: F.struct(m["question"].alias("question"), m["answer"].alias("answer"),
                                                   m["turn"].alias("turn")))


def with_history(blocks: DataFrame) -> DataFrame:
    """The pairs of ``blocks`` with ``conversation_history``: earlier blocks, then the earlier turns of their own."""
    prior = prior_turns(blocks).select(F.col("session_id").alias("_session"), F.col("block").alias("_block"), "prior")
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("block") == F.col("_block"))
    own = F.filter(F.col("_own"), lambda x: x["turn"] < F.col("_m._pair.turn_number"))
    return blocks.join(prior, same, "left") \
        .select("prior", _turns(F.col("members")).alias("_own"), F.explode("members").alias("_m")) \
        .select("_m._pair.*", F.when(F.col("prior").isNull(), own).otherwise(F.concat("prior", own)).alias("conversation_history"))


def qa_with_history(pairs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every earlier pair of the same session (turn strictly smaller), sorted by turn.

    Pairs that share a turn are not part of each other's history.
    """
    return with_history(history_blocks(pairs, block_turns))


def to_messages(history: Column, question: Column, answer: Column) -> Column:
    """history as alternating user / assistant messages, ending with the current pair."""
    past = F.flatten(F.transform(history, lambda h: F.array(
        F.struct(F.lit("user").alias("role"), h["question"].alias("content")),
        F.struct(F.lit("assistant").alias("role"), h["answer"].alias("content")))))
    now = F.array(F.struct(F.lit("user").alias("role"), question.alias("content")),
                  F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.concat(past, now)


def new_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs whose trace has not been scored yet."""
    done = evaluated_ids(scores)
    return pairs.join(done, "agent_trace_id", "left_anti")


def evaluated_ids(scores: DataFrame) -> DataFrame:
    """Distinct evaluated trace ids."""
    return scores.select("agent_trace_id").distinct()


# ---------------------------------------------------------------- default scorer (Spark expressions)

def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), WORD_SPLIT), "")


def _band(x: Column) -> Column:
    """Map a ratio in [0, 1] to a 1..5 score."""
    return (F.lit(1.0) + F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 4)).cast("float")


def default_scores(question: Column, answer: Column) -> Column:
    """V1 default scorer: a struct with the reference's 17 fields, no model call.

    intent_resolution: answer length band; relevance: share of distinct question
    words that the answer repeats; coherence: distinct / total answer words;
    fluency: mean answer word length near 5 letters.  Empty input -> error row.
    """
    qw, aw = _words(question), _words(answer)
    qd, ad = F.array_distinct(qw), F.array_distinct(aw)
    n_a = F.size(aw)
    alen = F.length(answer)
    intent = (F.when(alen < 20, 2.0).when(alen < 100, 3.0).when(alen < 400, 4.0).otherwise(5.0)).cast("float")
    relevance = _band(F.size(F.array_intersect(qd, ad)).cast("double") / F.greatest(F.size(qd), F.lit(1)))
    coherence = _band(F.size(ad).cast("double") / F.greatest(n_a, F.lit(1)))
    mean_len = F.aggregate(aw, F.lit(0), lambda acc, w: acc + F.length(w)).cast("double") / F.greatest(n_a, F.lit(1))
    fluency = _band(F.lit(1.0) - F.abs(mean_len - 5.0) / 5.0)
    empty = F.coalesce(F.length(F.trim(question)), F.lit(0)).eqNullSafe(0) | \
        F.coalesce(F.length(F.trim(answer)), F.lit(0)).eqNullSafe(0)
    fields = []
    for name, val in zip(METRICS, [intent, relevance, coherence, fluency]):
        v = F.when(~empty, val)
        fields += [v.alias(name),
                   F.when(~empty, F.concat(F.lit(f"offline {name} score "), v.cast("int").cast("string")))
                    .otherwise(F.lit("")).alias(f"{name}_reason"),
                   F.when(empty, F.lit("")).when(v >= THRESHOLD, "pass").otherwise("fail").alias(f"{name}_result"),
                   F.when(~empty, F.lit(THRESHOLD).cast("float")).alias(f"{name}_threshold")]
    fields.append(F.when(empty, F.lit("Empty question or answer")).alias("evaluation_error"))
    return F.struct(*fields)


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """V1: attach ``evaluation_results`` (17-field struct) to each pair.

    ``scorer`` takes a pandas frame with user_question, agent_answer and
    conversation_history and returns the 17 score columns; it runs per Arrow
    batch (one client per partition, not per row).
    """
    if scorer is None:
        return pairs.withColumn("evaluation_results", default_scores(F.col("user_question"), F.col("agent_answer")))
    from pyspark.sql.types import FloatType, StringType, StructField, StructType
    fields = [StructField(f, FloatType() if (f in METRICS or f.endswith("_threshold")) else StringType())
              for f in SCORE_FIELDS]
    out_schema = StructType(list(pairs.schema.fields) + fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = scorer(pdf)
            for f in SCORE_FIELDS:
                pdf[f] = res[f].values if f in res else None
            yield pdf

    scored = pairs.mapInPandas(run, out_schema)
    return scored.select(*pairs.columns, F.struct(*SCORE_FIELDS).alias("evaluation_results"))


def flatten_scores(scored: DataFrame, run_id: str, method: str = METHOD) -> DataFrame:
    """P20: struct fields to columns, stamped with run id, time and method."""
    keep = [c for c in PAIR_COLUMNS if c in scored.columns]
    return scored.select(*keep, "evaluation_results.*") \
        .withColumn("evaluated_at", F.current_timestamp()) \
        .withColumn("evaluation_run_id", F.lit(run_id)) \
        .withColumn("evaluation_method", F.lit(method))


def eval_overall(scores: DataFrame) -> DataFrame:
    """Count and means."""
    return scores.agg(F.count(F.lit(1)).alias("total_evaluations"),
                      *[F.round(F.avg(F.col(m).cast("double")), 6).alias(f"avg_{m}") for m in METRICS],
                      F.round(F.avg(F.col("response_time_ms").cast("double")), 6).alias("avg_response_time_ms"))


def eval_by_turn_type(scores: DataFrame) -> DataFrame:
    """First turn vs follow-up means."""
    tt = F.when(F.col("turn_number") == 1, "First Turn").otherwise("Follow-up")
    return scores.groupBy(tt.alias("turn_type")).agg(
        F.count(F.lit(1)).alias("count"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(f"avg_{m}") for m in METRICS])


def eval_distribution(scores: DataFrame) -> DataFrame:
    """Score distribution per metric in one pass (unpivot, then one groupBy)."""
    long = scores.unpivot([], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "score")
    return long.filter(F.col("score").isNotNull()).groupBy("metric", "score").agg(F.count(F.lit(1)).alias("count"))


def eval_quality(scores: DataFrame) -> DataFrame:
    """NULL count per metric and the error count."""
    return scores.agg(*[F.count(F.when(F.col(m).isNull(), 1)).alias(f"null_{m}") for m in METRICS],
                      F.count(F.when(F.col("evaluation_error").isNotNull(), 1)).alias("errors"))


def eval_describe(scores: DataFrame) -> DataFrame:
    """describe() of the metrics as numbers: one row per metric with count, mean,
    sample stddev, min and max (one pass: unpivot, then one groupBy)."""
    long = scores.unpivot([], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "score")
    return long.groupBy("metric").agg(
        F.count("score").alias("count"), F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.stddev_samp("score"), 6).alias("stddev"), F.min("score").alias("min"), F.max("score").alias("max"))


def score_increment(pairs: DataFrame, scores_path: str, run_id: str,
                    scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> int:
    """R14 (batch): score only unseen traces and append them to the scores table at ``scores_path``.

    A pair's history is taken from the scored pairs and the new ones together,
    restricted to the sessions that have new pairs, so scoring in one run or in
    several gives the same scores.

    Re-running with no new pairs appends nothing.  Returns the number of rows
    appended and the run's metrics, collected with ``observe`` during the write
    itself (no second pass, unlike the reference's repeated ``count()`` calls).
    """
    from pyspark.sql import Observation
    spark = pairs.sparkSession
    from ..sources.tables import read_path_or_empty
    existing = read_path_or_empty(spark, scores_path, _scores_schema(pairs))
    fresh = new_pairs(pairs.select(*PAIR_COLUMNS), existing)
    # history is that of the whole session: pairs scored before and new ones
    told = existing.select(*PAIR_COLUMNS).join(fresh.select("session_id").distinct(), "session_id", "left_semi")
    todo = qa_with_history(told.select(*PAIR_COLUMNS).unionByName(fresh)) \
        .join(fresh.select("agent_trace_id").distinct(), "agent_trace_id", "left_semi")
    out = flatten_scores(score_pairs(todo, scorer), run_id)
    out = out.select(*_scores_schema(pairs).fieldNames())
    obs = Observation(f"score_{run_id}")
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"),
                      F.count(F.col("evaluation_error")).alias("errors"),
                      *[F.count(F.when(F.col(m).isNull(), 1)).alias(f"null_{m}") for m in METRICS])
    out.write.mode("append").parquet(scores_path)
    return int(obs.get["rows"])


def _scores_schema(pairs: DataFrame):
    from pyspark.sql.types import FloatType, StringType, StructField, StructType, TimestampType
    base = [f for f in pairs.schema.fields if f.name in PAIR_COLUMNS]
    extra = [StructField(f, FloatType() if (f in METRICS or f.endswith("_threshold")) else StringType())
             for f in SCORE_FIELDS]
    stamp = [StructField("evaluated_at", TimestampType()), StructField("evaluation_run_id", StringType()),
             StructField("evaluation_method", StringType())]
    return StructType(base + extra + stamp)
