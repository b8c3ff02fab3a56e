"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing gives every token a sparse random index vector and sums, for
every token, the index vectors of the tokens around it.  Tokens are the words as
they stand and, beside each, its shape: runs of upper case, lower case and
digits shortened to one sign each, other characters kept, and whether the word
repeats the one before.  Both are hashed to a fixed number of rows, so the table
of vectors has a fixed size whatever the corpus; all documents contribute to it.

A document is the mean vector of its words and of its shapes, over the whole
text.  A network with one hidden layer is trained in numpy on a bounded sample
of labelled documents and calibrated by a temperature on a part of the sample
that the weights didn't see.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import SLICE, add_columns, fold, materialize

#: Rows of the vector table for words and for shapes, and the length of a vector.
WORD_ROWS, SHAPE_ROWS, DIM = 1 << 14, 1 << 12, 32
#: Blocks in which partial tables are summed up.
BLOCKS = 64
#: Labelled documents that the network is fitted on at most (the bounded sample).
MAX_TRAINING_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 256, 0.01

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


@lru_cache(maxsize=1)
def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each row's index vector the place of its +1 and of its -1."""
    places = np.random.default_rng(5).random((WORD_ROWS + SHAPE_ROWS, DIM)).argsort(axis=1)
    return places[:, 0].copy(), places[:, 1].copy()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, row of each word's shape, and the number of each text's first word."""
    raw, offsets = W.bytes_of(texts)
    starts, ends, first = W.bounds(raw, offsets)
    word = W.hashes(raw, starts, ends)
    # shorten runs inside words, then hash what is left of each word
    kind = _SHAPE[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != 97) & (kind[1:] != 65) & (kind[1:] != 48))
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = W.hashes(kind[kept], place[starts], place[ends])
    again = np.zeros(len(word), np.uint64)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = 0
    shape = W.stir(shape + again)
    return ((word % np.uint64(WORD_ROWS)).astype(np.int64),
            WORD_ROWS + (shape % np.uint64(SHAPE_ROWS)).astype(np.int64), first)


def _count_contexts(total: np.ndarray, word: np.ndarray, shape: np.ndarray, first: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours in the same text."""
    plus, minus = _index_vectors()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = text[1:] == text[:-1]
    flat = total.reshape(-1)
    pairs = [(word, shape)] + [(a[1:][near], b[:-1][near]) for a, b in ((word, word), (word, shape), (shape, shape))] \
        + [(a[:-1][near], b[1:][near]) for a, b in ((word, word), (word, shape), (shape, shape))]
    for token, context in pairs:
        np.add.at(flat, token * DIM + plus[context], 1)
        np.add.at(flat, token * DIM + minus[context], -1)


def train_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of unit vectors from all documents.

    Each task sums up one table of fixed size; the tables travel in blocks and
    are added as they arrive, so what a task holds doesn't depend on the input.
    """
    rows = WORD_ROWS + SHAPE_ROWS

    def partial(batches):
        total = np.zeros((rows, DIM), np.int64)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            _count_contexts(total, *tokens(batch.column(0)))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(
                [part.astype("<i8").tobytes() for part in np.array_split(total, BLOCKS)], pa.binary())], names=["block", "sums"])
        batch = None
        pa.default_memory_pool().release_unused()

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
            [s.tobytes() for s in sums.values()], pa.binary())], names=["block", "sums"])

    schema = "block int, sums binary"
    summed = docs.select(F.col(text).alias("text")).mapInArrow(partial, schema) \
        .repartition(BLOCKS // 4, "block").mapInArrow(added, schema).collect()  # the fixed-size table
    parts = {r["block"]: np.frombuffer(r["sums"], "<i8").reshape(-1, DIM) for r in summed}
    table = np.concatenate([parts[i] for i in range(BLOCKS)]).astype(np.float64) if parts else np.zeros((rows, DIM))
    length = np.sqrt((table ** 2).sum(axis=1, keepdims=True))
    return (table / np.maximum(length, 1)).astype(np.float32)


def _pooled(vectors: np.ndarray):
    """The function from a batch of whole texts to each one's mean word vector, mean shape vector and mean shape index vector."""
    plus, minus = _index_vectors()
    own = np.zeros((SHAPE_ROWS, DIM), np.float32)
    own[np.arange(SHAPE_ROWS), plus[WORD_ROWS:]] = 1
    own[np.arange(SHAPE_ROWS), minus[WORD_ROWS:]] = -1

    def step(column):
        word, shape, first = tokens(column)
        out = np.zeros((len(column), 3 * DIM), np.float32)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b > a:
                out[i, :DIM] = vectors[word[a:b]].mean(axis=0)
                kinds, n = np.unique(shape[a:b], return_counts=True)
                share = (n / (b - a)).astype(np.float32)
                out[i, DIM:2 * DIM] = share @ vectors[kinds]
                out[i, 2 * DIM:] = share @ own[kinds - WORD_ROWS]
        return out
    return step


def pool(docs: DataFrame, vectors: np.ndarray, text: str = "text", feature: str = "pooled") -> DataFrame:
    """``docs`` with each whole text's mean word vector, mean shape vector and mean shape index vector."""
    def make():
        pooled = _pooled(vectors)

        def step(column):
            offsets = np.arange(len(column) + 1, dtype=np.int32) * 3 * DIM
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(pooled(column).reshape(-1)))]
        return step

    return add_columns(docs, [text], T.StructType([T.StructField(feature, T.ArrayType(T.FloatType()))]), make)


class Network:
    """Standardised inputs, one hidden layer of tanh units, a logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = rng.permutation(len(x))
        held = order[:len(x) // 5]            # for the temperature
        fitted = order[len(x) // 5:]
        z = (x - self.middle) / self.spread
        self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        mean, square = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(fitted)
            for at in range(0, len(fitted), BATCH):
                step += 1
                for i, g in enumerate(self._gradient(z[fitted[at:at + BATCH]], y[fitted[at:at + BATCH]])):
                    g = g + 1e-4 * self.weights[i]
                    mean[i] = 0.9 * mean[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - RATE * (mean[i] / (1 - 0.9 ** step)) \
                        / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
        if len(held):
            logit = self._logit(z[held])
            loss = [np.logaddexp(0, np.where(y[held] >= 0.5, -1, 1) * logit / t).mean() for t in _TEMPERATURES]
            self.temperature = float(_TEMPERATURES[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d

    def _gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(z @ a + b)
        off = (_logistic(h @ c + d) - y) / len(y)
        back = off[:, None] * c[None, :] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ off, np.array([off.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logit((x - self.middle) / self.spread) / self.temperature)


_TEMPERATURES = np.geomspace(0.25, 8, 61)


def _logistic(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(v / 2))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, max_rows: int = MAX_TRAINING_ROWS,
             id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Labels of ids whose crc32 is 0 modulo ``folds`` are held out.  Of the others
    at most ``max_rows`` (those with the smallest hash of the id) train the
    network; its inputs come from the text alone.  Null labels are ignored, an
    id with several labels trains on their mean.  Every row is scored, null and
    empty texts as texts without words, repeated rows alike.  Without training
    rows every score is 0.5.  Input columns of the added names are replaced; an
    empty table gives an empty result.
    """
    vectors = train_vectors(docs, text)
    narrow = pool(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), vectors, "_text").drop("_text")
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & (fold(F.col(id), folds) != 0)) \
        .groupBy(F.col(id).alias("_id")).agg(F.avg(label).alias("_y"))
    sample = narrow.join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_rows).select("pooled", "_y").collect()
    network = Network(np.array([r["pooled"] for r in sample], np.float64), np.array([float(r["_y"]) for r in sample])) \
        if sample else None

    def make():
        pooled = _pooled(vectors)

        def step(column):
            x = pooled(column).astype(np.float64)      # pooled and scored in one step: one Python worker a task
            return [pa.array(network.score(x) if network else np.full(len(x), 0.5))]
        return step

    added = ("held_out", "score", "predicted", "pooled")
    scored = add_columns(docs.drop(*added), [text], T.StructType([T.StructField("score", T.DoubleType())]), make)
    return scored.withColumn("held_out", fold(F.col(id), folds) == 0) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
