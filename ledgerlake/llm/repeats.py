"""Words of passages that stand earlier in the corpus, found by recompression.

A text is a sequence of symbols, at first its words.  Each round replaces runs
of one symbol and then pairs of neighbours by new symbols.  A pair is replaced
when its left symbol is of the left class and its right one of the right class,
which depends on the symbols' names alone, so equal passages get equal symbols
but for some at their ends.  New symbols are named by 64-bit fingerprints of
their parts, and a Spark exchange per round settles for all shards at once which
names stand more than once in the corpus; the others are dead and stay as they
are.  Every symbol knows its zone, the words that determine that it stands there.

A window that holds the whole zone of a dead symbol can't stand anywhere else.
Only the other windows lie in repeated passages; they are verified by 96-bit
fingerprints of their words in one more exchange, which tells each shard whether
another one holds the same window in a smaller document.  All windows count as
found in the input, and each word that a later window covers is removed.

Exchanges are dealt by name, a row per shard and bucket; a shard sends each name
once, however often it holds it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize
from .shards import cut, one, stored, with_answers

WINDOW, ROUNDS = 20, 3
#: UTF-8 bytes of text in a shard, and shards whose names a bucket holds at most on average.
SHARD_BYTES, SHARDS_A_BUCKET = 1 << 22, 16
_RUN, _PAIR, _CLASS, _STEP, _CHECK = (np.uint64(x) for x in (
    0x8F2D3C7A91E5B641, 0xC53A9E0F7B1D2865, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
_NO_ID = np.iinfo(np.int64).max


class Parse:
    """Symbols of a shard's texts: names, zones (from, to; in words), the text of each and its bounds in words."""

    def __init__(self, texts: pa.Array):
        found, first = [], [np.zeros(1, np.int64)]
        ends = W.bytes_of(texts)[1]
        at = 0
        while at < len(texts):                        # hashed in pieces of about a megabyte
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
            h, f = W.word_hashes(texts.slice(at, to - at), lower=False)
            found.append(h)
            first.append(f[1:] + first[-1][-1])
            at = to
        self.words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)
        self.names = self.words
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.low = np.arange(len(self.words))
        self.high = self.low + 1
        self.dead = np.zeros(len(self.words), bool)
        self.new = self.dead

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol's right neighbour is of the same text, and how far left and right neighbours' zones go.

        Where there is no neighbour, that is a word beyond the text, which no window holds.
        """
        inner = self.text[1:] == self.text[:-1]
        left, right = self.first[self.text] - 1, self.first[self.text + 1] + 1
        left[1:][inner] = self.low[:-1][inner]
        right[:-1][inner] = self.high[1:][inner]
        return inner, left, right

    def _take(self, heads: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray) -> None:
        self.text, self.dead = self.text[heads], self.dead[heads] & ~new
        self.names, self.low, self.high, self.new = names, low, high, new

    def replace(self, turn: int) -> np.ndarray:
        """Replace runs, then pairs; the names of the symbols that are new in this round, sorted."""
        if not len(self.names):
            return self.names
        inner, left, right = self._neighbours()
        heads = np.flatnonzero(np.r_[True, ~(inner & (self.names[1:] == self.names[:-1]))])
        tails = np.r_[heads[1:], len(self.names)] - 1
        times = tails - heads + 1
        run = times > 1
        names = self.names[heads]
        names = np.where(run, W.stir(names * _RUN + times.astype(np.uint64)), names)
        fixed = self.dead[heads]                      # a dead symbol neither repeats nor pairs, whatever stands beside it
        self._take(heads, names, np.where(fixed, self.low[heads], np.minimum(self.low[heads], left[heads])),
                   np.where(fixed, self.high[heads], np.maximum(self.high[tails], right[tails])), run)
        inner, left, right = self._neighbours()
        salt = np.uint64(int(_CLASS) * (turn + 1) % 2**64)
        side = (W.stir(self.names + salt) >> np.uint64(40)) & np.uint64(1)
        opens, closes = ~self.dead & (side == 0), ~self.dead & (side == 1)
        pair = np.zeros(len(self.names), bool)
        pair[:-1] = inner & opens[:-1] & closes[1:]
        second = np.zeros(len(self.names), bool)
        second[1:] = pair[:-1]
        heads = np.flatnonzero(~second)
        both = pair[heads]
        other = np.minimum(heads + 1, len(self.names) - 1)
        names = np.where(both, W.stir(W.stir(self.names[heads] + _PAIR) * _STEP + self.names[other]), self.names[heads])
        low = np.where(closes[heads], np.minimum(self.low[heads], left[heads]), self.low[heads])
        high = np.where(opens[heads], np.maximum(self.high[heads], right[heads]), self.high[heads])
        self._take(heads, names, np.where(both, np.minimum(low, self.low[other]), low),
                   np.where(both, np.maximum(high, self.high[other]), high), both | self.new[heads])
        return np.unique(self.names[self.new])

    def settle(self, asked: np.ndarray, elsewhere: np.ndarray) -> None:
        """New symbols die if neither another shard holds their name nor this one twice."""
        at = np.searchsorted(asked, self.names[self.new])
        again = np.bincount(at, minlength=len(asked)) > 1
        self.dead = self.dead.copy()
        self.dead[self.new] = ~(elsewhere | again)[at]

    def suspects(self) -> np.ndarray:
        """First words of the windows that hold no dead symbol's zone."""
        n = len(self.words)
        start, end = self.first[self.text], self.first[self.text + 1]
        sure = self.dead & (self.low >= start) & (self.high <= end) & (self.high - self.low <= WINDOW)
        change = np.zeros(n + 2, np.int64)
        np.add.at(change, np.maximum(self.high[sure] - WINDOW, start[sure]), 1)
        np.add.at(change, self.low[sure] + 1, -1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        fits = np.arange(n) + WINDOW <= self.first[text + 1]
        return np.flatnonzero(fits & (np.cumsum(change)[:n] == 0))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit fingerprint of the words of each window."""
        one = np.zeros(len(starts), np.uint64)
        two = np.zeros(len(starts), np.uint64)
        for i in range(WINDOW):
            w = self.words[starts + i]
            one = (one + w) * _STEP
            one ^= one >> np.uint64(29)
            two = (two ^ w) * _CHECK
            two ^= two >> np.uint64(32)
        return W.stir(one), (W.stir(two) >> np.uint64(32)).astype(np.uint32)


def _ids(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


class _Windows:
    """The distinct suspect windows of a shard, each with the smallest id that holds it here."""

    def __init__(self, parse: Parse, ids: np.ndarray):
        self.starts = parse.suspects()
        one, two = parse.windows(self.starts)
        row = np.searchsorted(parse.first, self.starts, "right") - 1
        self.order = np.lexsort((self.starts, row, ids[row], two, one))
        one, two, self.row = one[self.order], two[self.order], row[self.order]
        self.id = ids[self.row]
        head = np.ones(len(one), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.entry = np.cumsum(head) - 1
        self.one, self.two, self.least = one[head], two[head], self.id[head]

    def later(self, smallest: np.ndarray) -> np.ndarray:
        """First words of the windows that start earlier elsewhere; ``smallest``: this shard has the smallest id."""
        opens = np.ones(len(self.entry), bool)
        opens[1:] = (self.entry[1:] != self.entry[:-1]) | (self.row[1:] != self.row[:-1])
        earliest = opens & (smallest & True)[self.entry] & (self.id == self.least[self.entry])
        return self.starts[self.order][~earliest]


def _bits(found: pa.Table, turn: int, n: int) -> np.ndarray:
    """The answers of one round in the order of the names that were asked."""
    rows = sorted((r for r in found.to_pylist() if r["turn"] == turn), key=lambda r: r["bucket"])
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} names")
    return out


def _parsed(mine: pa.Table, found: pa.Table, turns: int) -> Parse:
    parse = Parse(mine["texts"].combine_chunks().flatten())
    for turn in range(turns):
        asked = parse.replace(turn)
        parse.settle(asked, _bits(found, turn, len(asked)))
    return parse


def _dealt(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Buckets (the keys' leading bits) that hold some of the sorted keys, from where to where."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)]))


_ASK = "bucket long, shard long, n int, name binary, more binary, id binary"
_ANSWER = "shard long, bucket long, turn int, n int, bits binary"
_ANSWER_ARROW = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("turn", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def _ask(shard: int, bits: int, names: np.ndarray, more: np.ndarray, ids: np.ndarray) -> pa.Table:
    rows = [(b, shard, to - at, names[at:to].tobytes(), more[at:to].tobytes(), ids[at:to].tobytes()) for b, at, to in _dealt(names, bits)]
    kinds = [("bucket", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("name", pa.binary()), ("more", pa.binary()), ("id", pa.binary())]
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def _settled(asked: DataFrame, turn: int, decide: Callable) -> DataFrame:
    """The answers to what all shards ask, a bucket at a time."""
    def settle(rows: pa.Table) -> pa.Table:
        return _answers(rows.to_pylist(), turn, decide)
    return materialize(asked.groupBy("bucket").applyInArrow(settle, _ANSWER), f"repeats-turn{turn}")


def _answers(rows: list[dict], turn: int, decide: Callable) -> pa.Table:
    join = {c: np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("name", np.uint64), ("more", np.uint32), ("id", np.int64))}
    good = decide(join["name"], join["more"], join["id"])
    ends = np.cumsum([0] + [r["n"] for r in rows])
    return pa.Table.from_pylist([{"shard": r["shard"], "bucket": r["bucket"], "turn": turn, "n": r["n"],
                                  "bits": np.packbits(good[a:b]).tobytes()} for r, a, b in zip(rows, ends[:-1], ends[1:])], _ANSWER_ARROW)


def _elsewhere(names: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Names that several shards ask about."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    out = np.zeros(len(names), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def _smallest(names: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Windows whose id is the smallest that any shard has for them."""
    order = np.lexsort((ids, more, names))
    names, more, ids = names[order], more[order], ids[order]
    head = np.ones(len(names), bool)
    head[1:] = (names[1:] != names[:-1]) | (more[1:] != more[:-1])
    out = np.zeros(len(names), bool)
    if len(names):
        out[order] = ids == ids[np.flatnonzero(head)][np.cumsum(head) - 1]
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, n_words, n_removed, removed (runs of removed words: first, end) and kept (the other words, a space between).

    Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged.
    A window is WINDOW words of one row; removed is each word of a window whose
    words also start in a row of a smaller integer id or earlier in the same row.
    Rows without an id come after all others; neither they nor rows that share
    an id come before one another.  Null and empty texts have no words, a text
    longer than a shard is one of its own, other columns are ignored and an
    empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"))

    def collect(batches):
        for shard, batch in cut(batches, 0, size):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), one(batch.column(1)), one(batch.column(0))],
                                             names=["shard", "ids", "texts"])

    shards = stored(source.mapInArrow(collect, f"shard long, ids array<{kind}>, texts array<string>"), "repeats")
    spark = docs.sparkSession
    count = shards.agg(F.count("shard")).first()[0]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARDS_A_BUCKET))
    bits = (least - 1).bit_length()
    answers = spark.createDataFrame([], _ANSWER)

    def names_of(turn: int) -> Callable:
        def ask(mine: pa.Table, found: pa.Table) -> pa.Table:
            names = _parsed(mine, found, turn).replace(turn)
            return _ask(mine["shard"][0].as_py(), bits, names, np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return ask

    for turn in range(ROUNDS):
        asked = with_answers(shards.select("shard", "texts"), answers, names_of(turn), _ASK)
        answers = answers.unionByName(_settled(asked, turn, _elsewhere))

    def verify(mine: pa.Table, found: pa.Table) -> pa.Table:
        here = _Windows(_parsed(mine, found, ROUNDS), _ids(mine["ids"].combine_chunks().flatten()))
        return _ask(mine["shard"][0].as_py(), bits, here.one, here.two, here.least)

    asked = with_answers(shards, answers, verify, _ASK)
    answers = answers.unionByName(_settled(asked, ROUNDS, _smallest))

    def remove(mine: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = mine["ids"].combine_chunks().flatten(), mine["texts"].combine_chunks().flatten()
        parse = _parsed(mine, found, ROUNDS)
        here = _Windows(parse, _ids(ids))
        starts = here.later(_bits(found, ROUNDS, len(here.one)))
        change = np.zeros(len(parse.words) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        kept, spans, removed = [], [], []
        for value, a, b in zip(texts, parse.first[:-1].tolist(), parse.first[1:].tolist()):
            words, drop = (value.as_py() or "").encode().split(), gone[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, drop, False])).reshape(-1, 2).tolist()
            kept.append(b" ".join(words if not edges else [w for w, x in zip(words, drop.tolist()) if not x]).decode())
            spans.append([{"first": x, "end": y} for x, y in edges])
            removed.append(int(drop.sum()))
        return pa.table([ids, pa.array(np.diff(parse.first), pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                        names=["id", "n_words", "n_removed", "removed", "kept"])

    return with_answers(shards, answers, remove, f"id {kind}, n_words long, n_removed long, "
                        "removed array<struct<first: long, end: long>>, kept string").withColumnRenamed("id", doc_id)
