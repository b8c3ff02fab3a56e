"""N-gram Jaccard join by T-occurrence search.

Two texts link if their sets of word shingles have a Jaccard similarity of at
least ``percent`` / 100.  Documents with equal sets form one node.

Routing.  Linked sets share one of their first n - ceil(t n) + 1 shingles in any
order that is the same for all sets.  The order here is by frequency, rarest
first, counted over all nodes for the shingles whose hash lies in a fixed part
of the hash range (all sets' other shingles follow by hash).  A shingle held by
one node links nothing, so most nodes drop out.  Nodes that share a first
shingle and have similar sizes are connected to blocks.

Search.  Within a block, inverted lists over whole sets answer for each set
which smaller ones occur on at least T of its lists, T being the overlap that
the sizes require.  DivideSkip puts the longest lists aside, merges the short
ones on a heap that skips ahead, and looks up the few survivors in the long
lists by binary search.

Large blocks are split into chunks of bounded size.  Every chunk also gets the
block's first nodes, which joins most of a group of near copies at once.  Then
only nodes outside their block's largest component visit the other chunks that
hold a shingle they share with a node of another component.  So no link between
components is lost, and a group of many near copies costs no quadratic work.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import SLICE, add_columns, materialize
from .graph import components

#: Nodes and shingles of a chunk at most (a single larger set is a chunk of its own), and pivots of a split block.
CHUNK_NODES, CHUNK_SHINGLES, PIVOTS = 256, 400_000, 8
#: Percent of the hash range whose shingles are counted to order them by frequency.
COUNTED = 42
#: Bits of the table of nodes whose sets are needed; fixed, so a large corpus only lets more sets through to the join.
FILTER_BITS, FILTER_BLOCK = 1 << 26, 1 << 15
#: DivideSkip's weight of merging against probing, from its authors' experiments.
MU = 0.0085


def overlap_needed(n: int, m: int, percent: int) -> int:
    """The smallest i with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _set_hash(s: np.ndarray) -> int:
    """A node's key: 62 bits over the sorted set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = W.stir(np.array([W.stir(s + place).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(h[0] >> np.uint64(2))


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Shingle sets as sorted 63-bit numbers."""
    found = W.shingle_sets(*W.word_hashes(column), size)
    out = []
    for s in found:
        s = s >> np.uint64(1)
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """id, n, node of every row; a text without words has no node."""
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])

    def make():
        def step(column):
            sets = _sets(column, size)
            return [pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64())]
        return step

    return add_columns(docs, ["text"], added, make, keep=["id"])


def _nodes(docs: DataFrame, size: int, percent: int, universe: int) -> DataFrame:
    """row, node, n, counted (shingles below ``universe``) and the shingles that may be among its first ones.

    ``row`` is a short number for the node, fixed once the table is written.
    """
    added = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                          T.StructField("counted", T.LongType()), T.StructField("kept", T.ArrayType(T.LongType()))])

    def make():
        def step(column):
            sets = [s for s in _sets(column, size)]
            counted = [int(np.searchsorted(s, np.uint64(universe))) for s in sets]
            kept = [s[:max(c, len(s) - -(-percent * len(s) // 100) + 1)] for s, c in zip(sets, counted)]
            return [pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(counted, pa.int64()), _longs(kept)]
        return step

    rows = add_columns(docs, ["text"], added, make, keep=[])
    return rows.where("node is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("kept").alias("kept")) \
        .withColumn("row", F.monotonically_increasing_id())


def _routes(nodes: DataFrame, percent: int, universe: int) -> DataFrame:
    """node, key: a first shingle that other nodes hold as well, with a band of sizes.

    Sets that link differ in size by the factor percent / 100 at most, so they
    lie in the same band or in adjacent ones; each node joins its own band and
    the next.
    """
    postings = nodes.select("row", F.explode("kept").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("row")
    rows = postings.join(shared, "key").join(nodes.select("row", "node", "n", "counted"), "row") \
        .withColumn("outside", (F.col("key") >= universe).cast("int"))
    order = own.orderBy("outside", F.when(F.col("outside") == 0, F.col("df")).otherwise(0), "key")
    # shingles of this node alone come first in the order and were left out above
    place = F.col("counted") - F.sum(1 - F.col("outside")).over(own) + F.row_number().over(order)
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * (1 + 1e-9)))
    return rows.withColumn("place", place).where(F.col("place") <= first) \
        .select("node", F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))).alias("key"))


class Search:
    """Inverted lists over sets in order of size, and T-occurrence queries on them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sizes = [len(sets[i]) for i in self.order]
        shingles = np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, np.uint64)
        holder = np.repeat(np.arange(len(sets)), self.sizes)
        by_shingle = np.argsort(shingles, kind="stable")
        shingles, holder = shingles[by_shingle], holder[by_shingle]
        starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]]) if len(shingles) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(shingles)]
        self.lists = {int(shingles[a]): holder[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist())}

    def among(self, s: np.ndarray, lowest: int, limit: int, skip) -> list[int]:
        """Places in ``order`` from lowest to below limit whose sets link with ``s``, but those that ``skip`` names.

        ``skip`` is asked before the long lists are probed.
        """
        n, sizes, percent = len(s), self.sizes, self.percent
        lowest = max(lowest, bisect_left(sizes, -(-percent * n // 100)))
        limit = min(limit, bisect_left(sizes, n * 100 // percent + 1))
        if lowest >= limit:
            return []
        least = overlap_needed(n, sizes[lowest], percent)
        spans = []
        for shingle in s.tolist():
            held = self.lists.get(shingle)
            if held is not None:
                a, b = bisect_left(held, lowest), bisect_left(held, limit)
                if a < b:
                    spans.append((b - a, a, b, held))
        if len(spans) < least:
            return []
        spans.sort(key=lambda x: x[0])
        aside = min(least - 1, int(least / (MU * math.log2(spans[-1][0] + 1) + 1)))
        short, long = spans[:len(spans) - aside], spans[len(spans) - aside:]
        found = []
        for place, seen in _merged(short, least - aside):
            if skip(place):
                continue
            need = overlap_needed(n, sizes[place], percent)
            left = len(long)
            for _, a, b, held in long:
                if seen >= need or seen + left < need:
                    break
                left -= 1
                at = bisect_left(held, place, a, b)
                seen += at < b and held[at] == place
            if seen >= need:
                found.append(place)
        return found


def _merged(lists: list[tuple], least: int):
    """(place, count) of what occurs on at least ``least`` of the lists, by a heap that skips what cannot."""
    at = [a for _, a, _, _ in lists]
    heap = [(held[a], i) for i, (_, a, _, held) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        place = heap[0][0]
        popped = []
        while heap and heap[0][0] == place:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield place, len(popped)
            for i in popped:
                at[i] += 1
                if at[i] < lists[i][2]:
                    heapq.heappush(heap, (lists[i][3][at[i]], i))
            continue
        # whatever lies before the least-th list's next entry is on too few lists
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            return
        target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i][3], target, at[i], lists[i][2])
            if at[i] < lists[i][2]:
                heapq.heappush(heap, (lists[i][3][at[i]], i))


def _joined(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (node, smallest node) of the components among these sets."""
    search = Search(sets, percent)
    above = list(range(len(sets)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for place, i in enumerate(search.order):
        own = root(i)
        for other in search.among(sets[i], 0, place, lambda p: root(search.order[p]) == own):
            a, b = root(i), root(search.order[other])
            if a != b:
                above[a if nodes[a] > nodes[b] else b] = min(a, b, key=lambda x: nodes[x])
                own = root(i)
    return [(nodes[i], nodes[root(i)]) for i in range(len(sets)) if root(i) != i]


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in column.to_pylist()]


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _search_chunks(percent: int):
    """Of a group with several blocks: each block's components."""
    def run(group: pa.Table) -> pa.Table:
        blocks, nodes, sets = np.asarray(group["block"]), group["node"].to_pylist(), _unpacked(group["shingles"])
        found = []
        order = np.argsort(blocks, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1) if len(order) else []:
            own = {nodes[i]: sets[i] for i in part}   # a node may have come from several tasks
            found += _joined(list(own), list(own.values()), percent)
        return _edges(found)
    return run


def _search_visitors(percent: int):
    """Of a chunk and its visitors: a link of each visitor to each component that it has one to."""
    def run(group: pa.Table) -> pa.Table:
        visits, nodes, parts = np.asarray(group["visits"]), group["node"].to_pylist(), group["part"].to_pylist()
        sets = _unpacked(group["shingles"])
        home = {nodes[i]: i for i in np.flatnonzero(~visits)}
        index = list(home.values())
        search = Search([sets[i] for i in index], percent)
        found = []
        for v in {nodes[i]: i for i in np.flatnonzero(visits)}.values():
            known = {parts[v]}
            for p in search.among(sets[v], 0, len(index), lambda p: parts[index[search.order[p]]] in known):
                other = index[search.order[p]]
                if parts[other] not in known:
                    known.add(parts[other])
                    found.append((nodes[v], nodes[other]))
        return _edges(found)
    return run


def _needed_table(nodes: DataFrame) -> bytes:
    """A bit for each node, in a table of fixed size, put together in blocks."""
    slot = F.pmod("node", F.lit(FILTER_BITS))

    def collected(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(slots // FILTER_BLOCK):
                own = bits.setdefault(int(block), np.zeros(FILTER_BLOCK, bool))
                own[slots[slots // FILTER_BLOCK == block] % FILTER_BLOCK] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array(
            [np.packbits(b).tobytes() for b in bits.values()], pa.binary())], names=["block", "bits"])

    parts = nodes.select(slot.alias("slot")).repartition(16, F.floor(F.col("slot") / FILTER_BLOCK)) \
        .mapInArrow(collected, "block long, bits binary").collect()  # FILTER_BITS bits at most
    table = bytearray(FILTER_BITS // 8)
    for r in parts:
        table[r["block"] * FILTER_BLOCK // 8:(r["block"] + 1) * FILTER_BLOCK // 8] = r["bits"]
    return bytes(table)


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles: the whole sets of (at least) the wanted nodes, each once per task at most."""
    table = _needed_table(wanted)

    def read(batches):
        bits, sent = np.frombuffer(table, np.uint8), set()
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            out = []
            for s in _sets(batch.column(0), size):
                if len(s):
                    node = _set_hash(s)
                    slot = node % FILTER_BITS
                    if bits[slot >> 3] >> (7 - (slot & 7)) & 1 and node not in sent:
                        sent.add(node)
                        out.append((node, s.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                              pa.array([y for _, y in out], pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(read, "node long, shingles binary")


def _links(docs: DataFrame, size: int, percent: int, universe: int) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly what links connect."""
    nodes = materialize(_nodes(docs, size, percent, universe), "nodes")
    routes = materialize(_routes(nodes, percent, universe), "routes")
    hubs = routes.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_top")).where("hub <> _top").drop("_top")
    met = routes.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    blocks = components(met).withColumnRenamed("component", "block")
    sized = blocks.join(nodes.select("node", "n"), "node")
    sizes = sized.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    chunks = F.ceil(F.greatest(F.col("members") / CHUNK_NODES, F.col("total") / CHUNK_SHINGLES)).cast("int")
    placed = materialize(sized.join(sizes.select("block", "members", chunks.alias("chunks")), "block").withColumn(
        "chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")), "placed")
    sets = materialize(_whole_sets(docs, placed, size), "sets")  # those of other nodes drop out in the joins below
    # small blocks share groups; each chunk of a split block is a group and gets the block's pivots as well
    count, shingles = placed.where("chunks = 1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = max(1, -(-count // CHUNK_NODES), -(-shingles // CHUNK_SHINGLES))
    small = placed.where("chunks = 1").select("node", "block", F.struct(
        F.lit(0).cast("long").alias("b"), F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("c")).alias("cell"))
    split = placed.where("chunks > 1")
    first = Window.partitionBy("block").orderBy("node")
    pivots = split.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= PIVOTS).drop("_r") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = split.unionByName(pivots.select(split.columns)).distinct().select(
        "node", "block", F.struct(F.col("block").alias("b"), F.col("chunk").alias("c")).alias("cell"))
    found = materialize(small.unionByName(large).join(sets, "node").groupBy("cell")
                        .applyInArrow(_search_chunks(percent), "a long, b long"), "links")
    if split.isEmpty():
        return found
    parts = components(found).withColumnRenamed("component", "part")
    split = materialize(split.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "split")
    largest = split.groupBy("block", "part").agg(F.count(F.lit(1)).alias("k")) \
        .groupBy("block").agg(F.max(F.struct("k", "part")).alias("top")).select("block", F.col("top.part").alias("top"))
    minor = split.join(largest, "block").where("part <> top").select("node", "block", "chunk", "part")
    keyed = routes.select("node", "key").join(split.select("node", "block", "chunk", "part"), "node")
    # per key and chunk the smallest and largest component: one row, however many nodes hold the key there
    there = keyed.groupBy("key", "block", F.col("chunk").alias("to")).agg(F.min("part").alias("low"), F.max("part").alias("high"))
    visitors = keyed.join(minor.select("node"), "node", "left_semi").join(there, ["key", "block"]) \
        .where("to <> chunk and (low <> part or high <> part)").select("node", "block", F.col("to").alias("chunk"), "part").distinct()
    crowd = visitors.groupBy("block", "chunk").agg(F.ceil(F.count(F.lit(1)) / (4 * CHUNK_NODES)).cast("int").alias("turns"))
    rows = split.join(crowd, ["block", "chunk"]).select(
        "node", "part", F.lit(False).alias("visits"), "block", "chunk", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")) \
        .unionByName(visitors.join(crowd, ["block", "chunk"]).select(
            "node", "part", F.lit(True).alias("visits"), "block", "chunk",
            F.pmod(F.xxhash64("node", F.lit(5)), F.col("turns")).cast("int").alias("turn")))
    more = materialize(rows.join(sets, "node").groupBy("block", "chunk", "turn")
                       .applyInArrow(_search_visitors(percent), "a long, b long"), "links")
    return found.unionByName(more)


def join_components(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text",
                    counted: int = COUNTED) -> DataFrame:
    """id, n_shingles, component_id of every row.

    Words are the runs without ASCII white space, A-Z in lower case; a set holds
    the distinct shingles of ``size`` words, or the whole text if it has fewer.
    Sets link if 100 * intersection >= percent * union; component_id is the
    smallest id that links reach.  Null and empty texts and texts without words
    have no shingles and are their own component.  Rows with equal sets,
    repeated rows among them, share a component.  A null id counts as larger
    than all others.  Other columns are ignored; an empty table gives an empty
    result.  Sets and shingles are compared by 62- and 63-bit hashes.
    ``counted`` weighs the work of counting against that of searching; results
    don't depend on it.
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    universe = min(100, max(counted, 100 - percent + 10)) * (2**63 // 100)
    rows = materialize(_signed(source, size), "rows")
    links = _links(source.select("text"), size, percent, universe)
    joined = components(links)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("smallest")) \
        .join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_node = nodes.join(smallest, "component").select("node", "component_id")
    return rows.join(of_node, "node", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
