"""Learning from all documents, and what Python workers hold between tasks."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, lm, quality
from ledgerlake.llm.queries import RANKS

WORDS = "alpha beta gamma delta Epsilon zeta42 éta theta-iota kappa l'm ünder nu xi <omicron> pi rho".split()


def lines():
    with open(RANKS, "rb") as f:
        return f.read()


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 90))) for _ in range(n)]


def test_language_model_learns_from_documents_outside_the_first_fit(spark, monkeypatch):
    """The order of words in any one training text, which leaves all counts within words as they are, matters to the scores."""
    monkeypatch.setattr(lm, "TRAINING_DOCS", 3, raising=False)
    monkeypatch.setattr(lm, "FIRST_DOCS", 3, raising=False)
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = list(enumerate(texts(30, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    other = trained.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]     # last of all by hash
    changed = [(i, " ".join(t.split()[::-1]) if i == other else t) for i, t in rows]
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(x, "doc_id long, text string"),
                                                             RANKS, public_tokenizers.PATTERN).collect()} for x in (rows, changed))
    assert any(abs(a[i] - b[i]) > 1e-6 * abs(a[i]) for i in a if i != other)


def test_gradient_is_the_sum_over_all_texts(spark):
    """Every id of every text is predicted once, however the rows are spread."""
    subwords = lm.Subwords(lines(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    model = lm.Attention(np.r_[rng.integers(0, 5, subwords.end), 5])
    some = texts(40, 3) + ["", "one"]
    losses, uses, rows, total = 0.0, 0, np.zeros((subwords.end + 1, lm.DIM + 1)), None
    for t in some:
        ids = np.r_[subwords.end, subwords.encode(" " + t.lower()) if t else [], subwords.end].astype(int)
        for at in range(0, len(ids) - 1, lm.CONTEXT + lm.STRIDE):
            x, y = ids[at:at + lm.CONTEXT + lm.STRIDE], ids[at + 1:at + 1 + lm.CONTEXT + lm.STRIDE]
            loss, g = model.step(x[None, :len(y)], y[None], np.ones((1, len(y)), bool))
            losses, uses = losses + loss, uses + len(y)
            np.add.at(rows, x[:len(y)], np.c_[g.pop("e"), np.ones(len(y))])
            g["far"] = np.pad(g["far"], (0, lm.CONTEXT + lm.STRIDE - len(y)))
            total = g if total is None else {n: total[n] + g[n] for n in g}
    for parts in (1, 4):
        df = spark.createDataFrame([(t,) for t in some], "text string").repartition(parts)
        loss, got = lm._gradient(model, df, lines(), public_tokenizers.PATTERN)
        assert loss == pytest.approx(losses / uses, rel=1e-5)
        for n in total:
            assert got[n] == pytest.approx(total[n], rel=1e-3, abs=1e-3)
        assert got["e"] == pytest.approx(rows[:, :-1] / np.maximum(rows[:, -1:], 1), rel=1e-3, abs=1e-4)


def test_words_encoded_together_have_the_ids_they_have_alone():
    subwords = lm.Subwords(lines(), public_tokenizers.PATTERN)
    odd = [w.encode() for w in [*WORDS, " x", "x　", "a b", "\x1c", "it's", "'s", "...", "​", "日本語", "1234567", "x" * 200, "́a"]]
    got = subwords.all(odd)
    assert [np.frombuffer(p, "<i4").tolist() for p in got] == [subwords.encode(" " + w.decode()) for w in odd]
    subwords.forget()
    assert subwords.all(odd) == got


def test_scores_and_pooled_columns_of_the_classifier_come_from_one_python_step(spark):
    docs = spark.createDataFrame(list(enumerate(texts(20, 5))), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    plan = quality.classify(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_encoder_forgets_between_tasks():
    own = bpe.Encoder(lines(), public_tokenizers.PATTERN, "")
    text = " ".join(f"w{i}" for i in range(3 * bpe.KEPT))
    ids = own.packed(text)
    own.forget()
    assert all(len(d) <= bpe.KEPT and not d.older for d in (own.pieces, own.first, own.later))
    assert own.packed(text) == ids


@pytest.mark.parametrize("kind", [np.float64, np.float32])
@pytest.mark.parametrize("sharper", [1, 60])
def test_step_agrees_with_differences_of_its_loss(kind, sharper):
    """Unlikely ids, whose probability single precision can't hold, have their full loss; so do windows with places not held."""
    rng = np.random.default_rng(7)
    kinds = np.r_[rng.integers(0, 6, 29), 6]
    model = lm.Attention(kinds)
    for n in ("far", "b", "c"):
        model.w[n] = rng.normal(0, 0.3, model.w[n].shape)
    model.w = {n: (v * (sharper if n in ("q", "out") else 1)).astype(kind) for n, v in model.w.items()}
    size = lm.CONTEXT + lm.STRIDE
    x, y, held = rng.integers(0, 30, (3, size)), rng.integers(0, 30, (3, size)), np.ones((3, size), bool)
    held[1, 20:], held[2, :7] = False, False
    loss, g = model.step(x, y, held)

    def plain(w):
        total = 0.0
        for xs, ys, hs in zip(x, y, held):
            e = w["e"][xs]
            for i in np.flatnonzero(hs):
                seen = [j for j in range(i + 1) if hs[j]]
                a = np.array([e[i] @ w["q"] @ (e[j] @ w["k"]) / np.sqrt(lm.DIM) + w["far"][i - j] for j in seen])
                a = np.exp(a - a.max())
                u = np.maximum(e[i] @ w["own"] + (a / a.sum()) @ e[seen] @ w["v"] @ w["seen"] + w["b"], 0)
                z = u @ w["out"] + w["c"]
                total += z.max() + np.log(np.exp(z - z.max()).sum()) - z[kinds[ys[i]]]
        return total

    wide = {n: v.astype(np.float64) for n, v in model.w.items()}
    assert loss == pytest.approx(plain(wide), rel=1e-9 if kind is np.float64 else 1e-4)
    if kind is np.float64 and sharper == 1:
        of_ids = np.zeros_like(wide["e"])
        np.add.at(of_ids, x[held], g["e"][held.ravel()])
        for n, d in (g | {"e": of_ids}).items():
            for at in rng.choice(d.size, min(4, d.size), replace=False):
                low, high = ({**wide, n: wide[n] + by * (np.arange(d.size) == at).reshape(d.shape)} for by in (-1e-5, 1e-5))
                assert d.ravel()[at] == pytest.approx((plain(high) - plain(low)) / 2e-5, rel=1e-4, abs=1e-5)


def test_gradients_take_little_more_than_scoring():
    """They took over five times as long, a third of that for adding to the embeddings."""
    rng = np.random.default_rng(8)
    kinds = rng.integers(0, 84, 50_000)
    model = lm.Attention(kinds)
    ready, model.w = model.ready(), {n: v.astype(np.float32) for n, v in model.w.items()}
    ids, starts = rng.integers(0, len(kinds), 80_000).astype(np.int32), np.arange(0, 80_001, 800)
    dense, rows = np.zeros(2 + sum(v.size for n, v in model.w.items() if n != "e")), np.zeros((lm.DIM + 1, len(kinds)))

    def took(f, *a):
        began = time.thread_time()
        f(*a)
        return time.thread_time() - began
    a, b = (min(x) for x in zip(*[(took(lm.add_gradients, model, ids, starts, dense, rows), took(lm.score, ready, ids, starts)) for _ in range(5)]))
    assert dense[0] == rows[lm.DIM].sum() == 5 * (len(ids) - 100)
    assert a < 4 * b
