"""Each registered query against its DuckDB twin or a brute-force version, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ledgerlake.llm import bpe, mixing, ngram_join, quality
from ledgerlake.llm.queries import BLOCK_ROWS, ORACLE, OTHER_WEIGHT, QUERIES, RANKS, WEIGHTS
from tools.check_oracle import digest

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def encoding():
    ranks = dict((__import__("base64").b64decode(t), int(r)) for t, r in map(bytes.split, open(RANKS, "rb")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(expected)
    assert digest(df.columns, rows)[0] == digest(columns, expected)[0]


def test_op1_recall_and_scores(spark, small_dir):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()}
    found = defaultdict(list)
    for r in QUERIES["op1_cross_polytope_ann"](spark, small_dir).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r)
    assert set(found) == {i for i in rows if i % 50 == 0}
    hits = total = 0
    for q, got in found.items():
        cosine = {i: float(v @ rows[q]) / math.sqrt(float(v @ v) * float(rows[q] @ rows[q])) for i, v in rows.items() if i != q}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - cosine[r["vec_id"]]) < 1e-12 for r in got)
        hits, total = hits + len(set(best) & {r["vec_id"] for r in got}), total + 5
    assert hits / total >= 0.9


def test_op2_is_tiktoken(spark, small_dir, texts, encoding):
    got = {r["doc_id"]: r for r in QUERIES["op2_byte_level_bpe"](spark, small_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = encoding.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op3_held_out_accuracy(spark, small_dir):
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_classifier"](spark, small_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) >= 0.9


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    above = {i: i for i in texts}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_op7_components(docs, texts, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngram_join.join_components(docs, size, percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_op7_split_blocks(spark, monkeypatch):
    """Blocks of more than one chunk: pivots and visitors lose no link."""
    monkeypatch.setattr(ngram_join, "CHUNK_NODES", 6)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    rng = np.random.default_rng(4)
    rows = {}
    for g in range(3):
        base = [f"w{g}_{i}" for i in range(40)]
        for i in range(30):
            w = list(base)
            for at in rng.integers(0, 40, rng.integers(0, 4)):
                w[at] = f"x{rng.integers(0, 9)}"
            rows[len(rows)] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df, 3, 80).collect()}
    assert got == brute_components(rows, 3, 80)


def test_op8_counts_and_baseline(spark, small_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op8_attention_lm"](spark, small_dir).collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t) + ["end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens, r = words(t) + ["end"], got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] < 0


def test_op10_mix(spark, small_dir, docs):
    rows = QUERIES["op10_mix_sources"](spark, small_dir).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in rows] == list(range(docs.count()))
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["mix_block"], r["doc_id"]))
    for taken in by_source.values():
        assert [b for b, _ in taken] == [k // BLOCK_ROWS for k in range(len(taken))]
        assert [d for _, d in taken] == sorted(d for _, d in taken)


@pytest.mark.parametrize("blocks,weights", [
    ({"a": 70, "b": 33, "c": 5}, {"a": 5, "b": 2, "c": 1}), ({"a": 1}, {"a": 7}), ({}, {}),
    ({c: 20 + i for i, c in enumerate("abcdefgh")}, {c: i + 1 for i, c in enumerate("abcdefgh")})])
def test_pfair_deviation(blocks, weights):
    """In each phase no source is a block or more ahead of or behind its share, and every block keeps its window."""
    parts, pattern = mixing.phases(blocks, weights)
    at = {(p, s, b): t for p, s, b, t in pattern}
    slots = {}
    for phase, s, first, end, w, d, start in parts:
        for b in range(first, end):
            j = b - first
            t = j // w * d + at[phase, s, j % w]
            assert j * d // w <= t < -(-(j + 1) * d // w)
            assert start + t not in slots
            slots[start + t] = (phase, s, w, d)
    assert sorted(slots) == list(range(sum(blocks.values())))
    had, phase = Counter(), None
    for t in sorted(slots):
        p, s, _, _ = slots[t]
        if p != phase:
            phase, began, had = p, t, Counter()
        had[s] += 1
        for other in {x[1:] for x in slots.values() if x[0] == p}:
            assert abs(had[other[0]] - (t + 1 - began) * other[1] / other[2]) < 1


def test_pipeline_stages(spark, small_dir, docs, texts, encoding):
    (_, keep), (_, dedupe), (_, mix), (_, encode) = corpus_pipeline.STAGES
    scored = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{small_dir}/labels.parquet")).collect()}
    one = keep(spark, docs, small_dir)
    assert one.columns == docs.columns
    left = {r["doc_id"] for r in one.collect()}
    assert left == {i for i, p in scored.items() if p == 1}
    two = dedupe(spark, docs, small_dir)
    assert two.columns == docs.columns
    want = {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(want)
    three = mix(spark, docs, small_dir)
    order = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_ROWS).collect()}
    assert three.columns == docs.columns
    assert [r["doc_id"] for r in three.collect()] == sorted(order, key=order.get)
    four = encode(spark, docs, small_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in four} == {i: encoding.encode_ordinary(t) for i, t in texts.items()}


def test_bpe_random_pieces(encoding):
    """Random bytes, repeated letters, white space of all kinds: the ids are tiktoken's."""
    own = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN, bpe.newer_characters())
    rng = np.random.default_rng(9)
    parts = list(" \n\t\u00a0\u3000\x1c\x85") + ["a", "th", "'s", "9", "é", "ß", "!", "日", "\U000190db", "  ", "tion"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.integers(32, 0x2fff, 20))) for _ in range(500)] + ["a" * 5000, "ab" * 3000, ""]
    ids, offsets = own.ids(texts)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == encoding.encode_ordinary(t)
