"""Merkle manifest of a table: a tree per value of one column, and a tree over their roots.

The rows of a tree are numbered in order and cut into aligned partitions of
FANOUT ** LEVELS leaves, each of which hashes its own subtree in one task.  Then
the partitions' roots are exchanged as in a butterfly: in round r the partitions
of FANOUT neighbouring subtrees of FANOUT**r partitions meet, each with those
that stand at the same place in the other subtrees.  All of them hash the common
parent, so after the last round every partition knows its tree's root and the
siblings of all its ancestors; nothing is handed down from above.  A last
subtree that has fewer partitions than its neighbours sends its root in place of
those it lacks.

The roots of the trees are the leaves of one more tree, built by the same code.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

FANOUT = 8
#: Levels that a partition hashes on its own; it holds FANOUT ** LEVELS leaves at most.
LEVELS = 4

_UPPER = "array<struct<place: int, others: array<string>>>"


def record(values: list[Column]) -> Column:
    """The values one after another, each as its UTF-8 byte count, a colon and its text; nulls as a dash."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def _key(tree: Column) -> Column:
    """A text that is never null and sorts bytewise as the tree's value does, null first."""
    return F.when(tree.isNull(), "").otherwise(F.concat(F.lit("+"), tree.cast("string")))


def numbered(nodes: DataFrame, order: list[str], own: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, leaf and others) with at (place in the tree, from 0), n (leaves of the tree) and part.

    Rows go in ``order`` (nulls first), then by leaf; equal rows are
    interchangeable and split over tasks like all others.  Only offsets of
    sorted slices are computed over whole trees.
    """
    by = ["tree", *order, "leaf"]
    written = materialize(nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by, "tie")
                          .sortWithinPartitions(*by, "tie").drop("tie").withColumn("i", F.monotonically_increasing_id()),
                          "merkle-leaves").withColumn("slice", F.shiftright("i", 33))
    slices = written.groupBy("tree", "slice").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    slices = slices.select("tree", "slice", "first", F.sum("rows").over(tree).alias("n"), (F.sum("rows").over(
        tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")).alias("start"))
    return written.join(slices, ["tree", "slice"]).withColumn("at", F.col("start") + F.col("i") - F.col("first")) \
        .withColumn("part", F.expr(f"at div {FANOUT ** own}")).drop("slice", "first", "start", "i")


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]


def _levels(leaves: list[str], n: int, own: int) -> list[list[str]]:
    """The nodes of a partition level by level, up to its one root; ``n``: leaves of the whole tree."""
    out = [leaves]
    while len(out[-1]) > 1 or (n > FANOUT ** own and len(out) <= own):
        out.append(_parents(out[-1]))
    return out


def _path(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """Place and siblings of leaf ``i`` and of its ancestors below the partition's root."""
    path = []
    for level in levels[:-1]:
        a = i // FANOUT * FANOUT
        path.append((i - a, level[a:i] + level[i + 1:a + FANOUT]))
        i //= FANOUT
    return path


def partition_roots(leaves: DataFrame, own: int = LEVELS) -> DataFrame:
    """tree, part, parts (of the tree) and root of every partition."""
    def root(rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        ordered = rows.sort_by("at")["leaf"].to_pylist()
        return pa.table({"tree": rows["tree"][:1].cast(pa.string()), "part": rows["part"][:1].cast(pa.int64()),
                         "parts": pa.array([-(-n // FANOUT ** own)], pa.int64()),
                         "root": pa.array([_levels(ordered, n, own)[-1][0]], pa.string())})
    return leaves.select("tree", "part", "at", "n", "leaf").groupBy("tree", "part") \
        .applyInArrow(root, "tree string, part long, parts long, root string")


def exchange(parts: DataFrame) -> DataFrame:
    """tree, part, root (of the tree) and upper: of each level above the partition, its place and the other roots.

    One shuffle a round, of a row per partition; at most FANOUT rows meet.
    """
    held = parts.withColumn("upper", F.lit(None).cast(_UPPER))
    held = materialize(held.withColumn("upper", F.coalesce("upper", F.expr(f"cast(array() as {_UPPER})"))), "merkle-parts")
    most = held.agg(F.max("parts")).first()[0] or 0
    width = 1                                     # partitions under a node of this round
    while width < most:
        more = F.col("parts") > width             # the tree has several nodes yet
        node = F.expr(f"part div {width}")
        group = F.expr(f"part div {width * FANOUT}")
        own = F.expr(f"part % {width}")
        holders = F.least(F.lit(width), F.col("parts") - node * width)
        columns = F.least(F.lit(width), F.col("parts") - group * (width * FANOUT))
        sent = held.withColumn("group", F.when(more, group).otherwise(F.col("part"))) \
            .withColumn("place", F.when(more, node % FANOUT).otherwise(0).cast("int")).withColumn("own", own) \
            .withColumn("column", F.explode(F.when(more, F.sequence(own, columns - 1, holders)).otherwise(F.array(own))))
        met = sent.groupBy("tree", "group", "column", "parts").agg(F.array_sort(F.collect_list(F.struct(
            "place", "root", "part", (F.col("column") == F.col("own")).alias("own"), "upper"))).alias("met"))
        roots = met.withColumn("roots", F.expr("transform(met, m -> m.root)"))
        held = roots.withColumn("m", F.explode(F.expr("filter(met, m -> m.own)"))).select(
            "tree", F.col("m.part").alias("part"), "parts",
            F.when(more, digest(F.array_join("roots", ""))).otherwise(F.col("m.root")).alias("root"),
            F.when(more, F.concat("m.upper", F.array(F.struct(F.col("m.place").alias("place"), F.expr(
                "filter(roots, (r, i) -> i <> m.place)").alias("others"))).cast(_UPPER))).otherwise(F.col("m.upper")).alias("upper"))
        width *= FANOUT
    return held.drop("parts")


def _fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    for place, others in path:
        node = sha256("".join([*others[:place], node, *others[place:]]).encode()).hexdigest()
    return node


def proofs(leaves: DataFrame, held: DataFrame, own: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (of all siblings on the way up) and folded of every leaf.

    ``held`` has tree, part, subroot, root and upper; folded is what the leaf's
    column found folds to along the leaf's siblings.
    """
    rows = leaves.select("tree", "part", "at", "n", "id", "leaf", "found")

    def prove(mine: pa.Table, above: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        levels = _levels(mine["leaf"].to_pylist(), mine["n"][0].as_py(), own)
        upper = [(u["place"], u["others"]) for u in above["upper"][0].as_py()]
        proof, folded = [], []
        for i, node in enumerate(mine["found"].to_pylist()):
            path = _path(levels, i) + upper
            proof.append(sha256("".join("".join(others) for _, others in path).encode()).hexdigest())
            folded.append(_fold(node, path))
        same = [pa.array(above[c].to_pylist() * len(mine), pa.string()) for c in ("subroot", "root")]
        return pa.table([mine["id"], mine["leaf"].cast(pa.string()), *same, pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                        names=["id", "leaf", "subroot", "root", "proof_sha256", "folded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("tree", "part").cogroup(held.groupBy("tree", "part")) \
        .applyInArrow(prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded string")


def paths(leaves: DataFrame, held: DataFrame, own: int = LEVELS) -> DataFrame:
    """value, over (the levels above, as in upper) and root of every leaf."""
    def trace(mine: pa.Table, above: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        levels = _levels(mine["leaf"].to_pylist(), mine["n"][0].as_py(), own)
        upper = above["upper"][0].as_py()
        over = [[{"place": place, "others": others} for place, others in _path(levels, i)] + upper for i in range(len(mine))]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
        return pa.table([mine["value"].cast(pa.string()), pa.array(over, kind), pa.array(above["root"].to_pylist() * len(mine), pa.string())],
                        names=["value", "over", "root"])

    return leaves.select("tree", "part", "at", "n", "leaf", "value").groupBy("tree", "part") \
        .cogroup(held.groupBy("tree", "part")).applyInArrow(trace, f"value string, over {_UPPER}, root string")


def manifest(rows: DataFrame, columns: list[str], tree: str, order: str, presented: dict[str, Column] | None = None,
             own: int = LEVELS) -> DataFrame:
    """Digests and proofs of every row: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``columns``.  There is a tree per value of ``tree``
    (null is one of them) with its leaves by ``order`` (nulls first, then by
    digest), and a tree over the roots by value (null first, the others by their
    UTF-8 bytes).  ``presented`` replaces columns in the copies of the rows that
    are checked against the proofs (default: the rows themselves): folded_root
    is what such a copy folds to along its row's siblings, and verified whether
    that is the root.  Rows that are repeated are leaves each, empty and null
    texts differ, other columns are ignored, and an empty table gives no rows.
    """
    presented = presented or {}
    nodes = rows.select(_key(F.col(tree)).alias("tree"), F.col(order).alias("id"),
                        digest(record([F.col(c) for c in columns])).alias("leaf"),
                        digest(record([presented.get(c, F.col(c)) for c in columns])).alias("found"))
    leaves = numbered(nodes, ["id"], own)
    below = materialize(exchange(partition_roots(leaves, own)), "merkle-trees")
    tops = numbered(below.where("part = 0").select(F.lit("").alias("tree"), F.col("tree").alias("value"),
                                                  F.col("root").alias("leaf")), ["value"], own)
    above = paths(tops, exchange(partition_roots(tops, own)), own).withColumnRenamed("value", "tree")
    held = below.withColumnRenamed("root", "subroot").join(above, "tree") \
        .select("tree", "part", "subroot", "root", F.concat("upper", "over").alias("upper"))
    return proofs(leaves, held, own).select(
        F.col("id").alias(order), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
