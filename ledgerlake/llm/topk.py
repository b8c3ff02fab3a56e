"""Exact top-k by inner product: dual-tree search over cover trees.

A cover tree's node has a centre and the covering radius of its points; its
children's centres are chosen farthest-first until they cover the points at a
smaller scale.  For a query node with centre c and radius r and a row node with
centre d and radius s no inner product exceeds

    c.d + r |d| + s |c| + r s

so the pair is dropped if that bound is below the kth best score that every
query of the node already has.

The top of the tree is spread over the cluster: rows go to the nearest of a
bounded number of pivots.  Each query first searches its own pivot's rows; then
the bound, with the pivots as centres and the worst kth score of the queries
there, drops pairs of pivots; the rest is searched with those scores as floors.
Within a task, rows and queries get trees of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize
from .vectors import best, matrix, meet, usable

#: Pivots: one for so many rows, and no more than the driver can pair.
ROWS_PER_PIVOT, MAX_PIVOTS = 4096, 256
ROW_CHUNK, QUERY_CHUNK = 8192, 2048
LEAF, FANOUT, SCALE = 256, 16, 1.5


class Node:
    """Points (row numbers), their centre, covering radius and children."""

    __slots__ = ("points", "centre", "length", "radius", "children")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: np.ndarray):
        away = np.sqrt(((x[points] - centre) ** 2).sum(axis=1))
        self.points, self.centre = points, centre
        self.length, self.radius = float(np.sqrt((centre ** 2).sum())), float(away.max(initial=0))
        self.children: list[Node] = []
        if len(points) <= LEAF or self.radius == 0:
            return
        # farthest-first centres, until they cover the points at the next scale
        nearest, own = away, np.zeros(len(points), np.int64)
        centres = [centre]
        while len(centres) < FANOUT and nearest.max() > self.radius / SCALE:
            centres.append(x[points[nearest.argmax()]])
            there = np.sqrt(((x[points] - centres[-1]) ** 2).sum(axis=1))
            own[there < nearest] = len(centres) - 1
            nearest = np.minimum(nearest, there)
        parts = [points[own == i] for i in range(len(centres))]
        if max(map(len, parts)) == len(points):
            return
        self.children = [Node(x, p, c) for p, c in zip(parts, centres) if len(p)]

    def halves(self) -> list[Node]:
        return self.children or [self]


def bound(a: Node, b: Node) -> float:
    """No inner product of a point of one and a point of the other is larger (with room for rounding)."""
    top = float(a.centre @ b.centre) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
    return top + 1e-9 * (a.radius + a.length) * (b.radius + b.length) + 1e-6


def cover_tree(x: np.ndarray) -> Node:
    return Node(x, np.arange(len(x)), x[0])


def dual_tree(queries: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, row_ids: np.ndarray,
              k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, id) above or at its floor, ties to the smaller id.

    An id with several rows counts once, with its best score.  All numbers are
    integers and every sum is exact in double precision.
    """
    different, place = np.unique(row_ids, return_inverse=True)
    step = len(different) + 1
    # score and the id's place as one integer: the larger wins, of equal scores the smaller id
    top = np.full((len(queries), k), np.iinfo(np.int64).min)
    worst = floor.astype(np.float64).copy()
    stack = [(cover_tree(queries), cover_tree(rows))]
    while stack:
        a, b = stack.pop()
        if bound(a, b) < worst[a.points].min():
            continue
        if a.children or b.children:
            # the most promising pair is searched first
            stack += sorted(((c, d) for c in a.halves() for d in b.halves()), key=lambda p: bound(*p))
            continue
        scores = (queries[a.points] @ rows[b.points].T).astype(np.int64)
        packed = scores * step + (len(different) - place[b.points])[None, :]
        packed[query_ids[a.points][:, None] == row_ids[b.points][None, :]] = np.iinfo(np.int64).min
        packed[scores < worst[a.points][:, None]] = np.iinfo(np.int64).min
        joined = np.concatenate([top[a.points], packed], axis=1)
        if len(different) < len(rows):
            joined = once(joined, step)
        top[a.points] = best_k = np.partition(joined, -k, axis=1)[:, -k:]
        full = best_k[:, 0] > np.iinfo(np.int64).min
        worst[a.points[full]] = np.maximum(worst[a.points[full]], best_k[full, 0] // step)
    return [[(int(p // step), int(different[len(different) - p % step])) for p in line if p > np.iinfo(np.int64).min]
            for line in top]


def once(packed: np.ndarray, step: int) -> np.ndarray:
    """Of each line's numbers that are equal modulo ``step`` (one id's) only the largest is left."""
    own = packed % step
    order = np.lexsort((~packed, own), axis=-1)
    packed, own = np.take_along_axis(packed, order, 1), np.take_along_axis(own, order, 1)
    packed[:, 1:][own[:, 1:] == own[:, :-1]] = np.iinfo(np.int64).min
    return packed


def plain(queries, rows, query_ids, row_ids, k, floor) -> list[list[tuple[int, int]]]:
    """The same by Python's unbounded integers, for numbers too large to be exact in double precision."""
    whole = [[int(v) for v in row] for row in rows]
    out = []
    for q, own in zip(queries, query_ids):
        q = [int(v) for v in q]
        least = {}
        for row, i in zip(whole, row_ids):
            if i != own:
                s = -sum(a * b for a, b in zip(q, row))
                least[int(i)] = min(s, least.get(int(i), s))
        scored = sorted((s, i) for i, s in least.items())
        out.append([(max(min(-s, 2**63 - 1), -2**63), i) for s, i in scored[:k]])
    return out


def _search(k: int):
    def search(group: pa.Table) -> pa.Table:
        asked, ids = np.asarray(group["_query"]), group["id"].to_numpy()
        x = matrix(group["vector"])
        floor = np.nan_to_num(group["floor"].to_numpy().astype(np.float64)[asked], nan=-np.inf)
        largest = np.abs(x).max(initial=0)
        exact = x.shape[1] * largest * largest * (len(x) + 1) < 2.0 ** 62 and x.shape[1] * largest * largest < 2.0 ** 52
        found = (dual_tree if exact else plain)(x[asked], x[~asked], ids[asked], ids[~asked], k, floor)
        query = [q for q, line in zip(ids[asked], found) for _ in line]
        return pa.table({"query_id": pa.array(query, pa.int64()),
                         "vec_id": pa.array([i for line in found for _, i in line], pa.int64()),
                         "score": pa.array([s for line in found for s, _ in line], pa.int64())})
    return search


def _assigned(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its nearest pivot and the distance to it."""
    added = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def make():
        def step(column):
            x = matrix(column)
            if not len(x):
                return [pa.array([], pa.int32()), pa.array([], pa.float64())]
            away = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            near = away.argmin(axis=1)
            return [pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(x)), near])]
        return step

    return add_columns(df, ["vector"], added, make)


def _scaled(df: DataFrame, scale: float) -> DataFrame:
    def make():
        def step(column):
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
        return step
    return add_columns(df, ["vector"], T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType()))]), make)


def top_products(rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0,
                 id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products.

    Components become floor(scale * x).  ``rows`` and ``queries`` have the
    columns ``id`` (integer) and ``vector``; others are ignored.  Rows with the
    query's own id are no candidates.  Rows without an id and vectors that are
    null, empty or not finite take no part; zero vectors do.  Vectors of
    different lengths aren't compared.  Repeated ids count once, with their
    best score.  Ties go to the smaller id.  Scores beyond 64 bits are
    reported as the nearest 64-bit number.  Empty tables give an empty result.
    """
    def sound(df: DataFrame) -> DataFrame:
        out = df.where(usable(F.col(vector)) & F.col(id).isNotNull()) \
            .select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
        return materialize(_scaled(out, scale).distinct(), "topk-once")

    rows, queries = sound(rows), sound(queries)
    dims = [r["dim"] for r in rows.select(F.size("vector").alias("dim")).distinct().collect()]  # as many as lengths
    parts = [_of_one_length(rows.where(F.size("vector") == d), queries.where(F.size("vector") == d), k) for d in dims]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_one_length(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n = rows.count()
    # any rows serve as pivots: they decide what is pruned, not what is found
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, -(-n // ROWS_PER_PIVOT))).collect()
    pivots = np.array([r["vector"] for r in chosen])
    rows, queries = materialize(_assigned(rows, pivots), "topk-rows"), materialize(_assigned(queries, pivots), "topk-queries")

    def searched(r: DataFrame, q: DataFrame) -> DataFrame:
        return meet(r, q, ["pivot"], ROW_CHUNK, QUERY_CHUNK).groupBy("_group") \
            .applyInArrow(_search(k), "query_id long, vec_id long, score long")

    home = materialize(best(searched(rows.drop("away"), queries.drop("away")), k), "topk-home")
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    queries = queries.join(floors.select(F.col("query_id").alias("id"), F.col("floor").cast("double")), "id", "left")
    worst = F.min(F.coalesce("floor", F.lit(float("-inf"))))
    # one row per pivot
    asked = queries.groupBy("pivot").agg(F.max("away").alias("radius"), worst.alias("worst")).collect()
    covered = rows.groupBy("pivot").agg(F.max("away").alias("radius")).collect()
    length = np.sqrt((pivots ** 2).sum(axis=1))
    pairs = []
    for a in asked:
        for b in covered:
            p, q = a["pivot"], b["pivot"]
            top = pivots[p] @ pivots[q] + a["radius"] * length[q] + b["radius"] * length[p] + a["radius"] * b["radius"]
            if p != q and top * (1 + 1e-9) + 1e-6 >= a["worst"]:
                pairs.append((p, q))
    if not pairs:
        return home
    routes = rows.sparkSession.createDataFrame(pairs, "pivot int, to int")
    sent = queries.join(F.broadcast(routes), "pivot").select(F.col("to").alias("pivot"), "id", "vector", "floor")
    return best(home.drop("rank").unionByName(searched(rows.drop("away"), sent)), k)
