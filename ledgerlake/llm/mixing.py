"""Mix sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` rows.  With weight w (its share
of all slots) its j-th block is released at slot floor(j / w) and due by slot
ceil((j + 1) / w).  Each slot goes to the released block that is due first
(earliest deadline first), so that after t slots a source has had more than
w t - 1 and fewer than w t + 1 of them.

Weights are positive integers.  While a set of sources lasts, the schedule
repeats every D slots, D being the sum of their weights, so one period is worked
out on the driver (D entries) and every block's slot follows from it by
arithmetic.  When a source has no blocks left, a new phase begins with the
others' weights.  No row is dropped or repeated: the mix is an order of all rows.

Weights are divided by their greatest common divisor first, in every phase anew.

Every phase ends with the last block of exactly one source, so all rows of a
phase follow the same short last blocks: what those lack is one number a phase.

What the driver holds depends on the number of sources and the weights only:
at most sources x sum of weights entries, which ``MAX_PATTERN`` limits.  With
equal weights 1,900 sources of any size fit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import _quoted, materialize

#: Entries of the repeating patterns of all phases together.
MAX_PATTERN = 2_000_000


def one_period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """Earliest-deadline-first over one period: the source and its block of each slot."""
    total = sum(weights.values())
    coming = [(0, name, 0) for name in weights]      # (release, source, block)
    ready: list[tuple[int, str, int]] = []           # (deadline, source, block)
    heapq.heapify(coming)
    slots = []
    for now in range(total):
        while coming and coming[0][0] <= now:
            _, name, block = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[name]), name, block))
        _, name, block = heapq.heappop(ready)
        slots.append((name, block))
        if block + 1 < weights[name]:
            heapq.heappush(coming, ((block + 1) * total // weights[name], name, block + 1))
    return slots


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """The schedule of all blocks.

    First: (phase, source, first block, end block, blocks a period, period, first slot).
    Second: (phase, source, block within the period, slot within the period).
    Phase k ends with the last block of the k-th source to run out.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    parts, pattern, start, phase = [], [], 0, 0
    while left:
        common = math.gcd(*(weights[s] for s in left))
        now = {s: weights[s] // common for s in left}
        period = sum(now.values())
        if len(pattern) + period > MAX_PATTERN:
            raise ValueError(f"the weights of {len(blocks)} sources need a pattern of over {MAX_PATTERN} slots")
        slots = one_period(now)
        at = {(s, b): t for t, (s, b) in enumerate(slots)}
        # the phase ends with the slot that takes some source's last block
        end = min((n - 1) // now[s] * period + at[s, (n - 1) % now[s]] for s, n in left.items()) + 1
        rounds, rest = divmod(end, period)
        taken = {s: rounds * w for s, w in now.items()}
        for s, _ in slots[:rest]:
            taken[s] += 1
        parts += [(phase, s, done[s], done[s] + taken[s], now[s], period, start) for s in now if taken[s]]
        pattern += [(phase, s, b, t) for (s, b), t in at.items()]
        start, phase = start + end, phase + 1
        for s, n in taken.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return parts, pattern


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows numbered from 0 within their source ``_s`` (as ``_i``), and the rows of each source.

    The rows are spread over sorted ranges of (source, order), so a source that
    has a third of all rows lies in many partitions.  They are written with
    their running number there; per (partition, source) the numbers are shifted
    by the source's rows in earlier partitions.  That table has one row per
    partition and per source at most, hence the broadcast.
    """
    ranged = materialize(df.repartitionByRange("_s", *order).sortWithinPartitions("_s", *order)
                         .withColumn("_p", F.spark_partition_id())
                         .withColumn("_m", F.monotonically_increasing_id()), "mix")
    slices = ranged.groupBy("_p", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    earlier = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = slices.select("_p", "_s", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_m0")).alias("_shift"))
    rows = ranged.join(F.broadcast(shifts), ["_p", "_s"]).withColumn("_i", F.col("_m") + F.col("_shift")) \
        .drop("_p", "_m", "_shift")
    return rows, slices.groupBy("_s").agg(F.sum("_n").alias("n"))


#: Columns that ``mix`` adds.
ADDED = ["mix_block", "mix_release", "mix_deadline", "mix_phase", "mix_slot", "mix_position"]


def mix(df: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64,
        source: str = "source", order: list[str] | None = None) -> DataFrame:
    """``df`` with the place of every row in the mix.

    Adds mix_block (the row's block within its source), mix_release and
    mix_deadline (that block's window, in slots of its phase), mix_phase,
    mix_slot (over all phases) and mix_position (from 0, without gaps).  Sources
    without a weight get ``default_weight``.  Within a source rows keep ``order``
    (default: doc_id), nulls first; rows that agree in all of ``order`` follow
    the hash of all their columns that have one order, so only equal rows may
    change places.  Rows without a source are a source of their own, weighted as
    "".  Input columns of the added names are replaced, all others come back
    whatever their names, as the input travels as one column; an empty table
    gives an empty result.
    """
    order = order or ["doc_id"]
    if default_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ADDED]
    name = F.col(_quoted(source))
    base = df.select(
        F.concat(F.when(name.isNull(), "-").otherwise("+"), F.coalesce(name, F.lit(""))).alias("_s"),
        *[F.col(_quoted(c)).alias(f"_o{k}") for k, c in enumerate(order)],
        F.xxhash64(F.lit(0), *[F.col(_quoted(f.name)) for f in df.schema if f.name in kept
                               and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)])
        .alias("_h"),
        F.struct(*[F.col(_quoted(c)) for c in kept]).alias("_row"))
    rows, sizes = _numbered(base, [f"_o{k}" for k in range(len(order))] + ["_h"])
    counts = {r["_s"]: r["n"] for r in sizes.collect()}          # one row per source
    weight = {s: int(weights.get(s[1:], default_weight)) for s in counts}
    parts, pattern = phases({s: -(-n // block_rows) for s, n in counts.items()}, weight)
    # the last block of a source may be short: what it lacks shifts the rows of all later phases
    lacking, total = [0], {}
    for phase, s, _, end, *_ in parts:
        total[phase] = total.get(phase, 0) + max(0, end * block_rows - counts[s])
    for phase in sorted(total):
        lacking.append(lacking[-1] + total[phase])
    plan = spark.createDataFrame([(*part, lacking[part[0]]) for part in parts],
                                 "mix_phase int, _s string, _first long, _end long, _w long, _d long, _start long, _gap long")
    slots = spark.createDataFrame(pattern, "mix_phase int, _s string, _b long, _t long")
    in_phase = F.col("mix_block") - F.col("_first")
    out = rows.withColumn("mix_block", F.floor(F.col("_i") / block_rows)) \
        .join(F.broadcast(plan), ["_s"]).where(F.col("mix_block").between(F.col("_first"), F.col("_end") - 1)) \
        .withColumn("_b", in_phase % F.col("_w")).withColumn("_round", F.floor(in_phase / F.col("_w"))) \
        .join(F.broadcast(slots), ["mix_phase", "_s", "_b"]) \
        .withColumn("mix_slot", F.col("_start") + F.col("_round") * F.col("_d") + F.col("_t")) \
        .withColumn("mix_release", F.expr("(mix_block - _first) * _d div _w")) \
        .withColumn("mix_deadline", F.expr("((mix_block - _first + 1) * _d + _w - 1) div _w")) \
        .withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("_i") % block_rows - F.col("_gap"))
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], *[F.col(c).cast("long").alias(c) for c in ADDED])


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows in ascending mix_position, over partitions in that order too: written files follow the mix."""
    return mixed.repartitionByRange(F.col("mix_position")).sortWithinPartitions("mix_position")
