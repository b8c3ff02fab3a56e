"""Filter audit, substring dedup and Merkle manifest against brute force, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import doc_term, filter_audit, merkle, repeats

LONG = "lorem ipsum dolor " * 60_000


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- documents x terms, filter audit ---

DOCS = "doc_id long, lang string, text string"
ROWS = [(1, "en", None), (2, "en", ""), (3, "fr", "one two three one"), (3, "fr", "one two three one"), (4, None, "ONE TWO & three"),
        (None, "en", "one two three one"), (5, "", LONG), (6, "de", " \n\t\x0b "), (7, "de", "é ü word word"),
        (8, "en", " ".join(f"w{i}" for i in range(120))), (9, "en", " ".join(f"w{i}" for i in range(120))), (None, None, None)]


def brute_failures(rows):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, lang, t in rows:
        t = t or ""
        w = t.encode().split()
        fail = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                any(c in t for c in "#$%&*|"), i is not None and least[t] < i]
        out.append((lang or "", "".join(f for f, x in zip("ABCDE", fail) if x)))
    return out


def brute_audit(failed):
    """failed: (part, letters, good, toxic) -> {(part, order, step): counts}, document by document."""
    out = {(part, "".join(o), s): [0] * 7 for part in {f[0] for f in failed} for o in permutations("ABCDE") for s in range(1, 6)}
    shapley = Counter()
    for part, letters, good, toxic in failed:
        for o in map("".join, permutations("ABCDE")):
            at = next((k for k, f in enumerate(o, 1) if f in letters), 9)
            for s, f in enumerate(o, 1):
                c = out[part, o, s]
                c[0] += at > s
                c[1] += at == s
                c[2] += at < s and f in letters
                c[3] += letters == f
                c[4] += at == s and good
                c[5] += at == s and toxic
                if at == s:
                    shapley[part, f] += 1
    for (part, o, s), c in out.items():
        c[6] = shapley[part, o[s - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_a_loop_over_documents(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("words", F.lit(0)).withColumn("fails", F.lit("x")).withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (99, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    failed = filter_audit.failures(docs, labels)
    rows = failed.collect()
    want = brute_failures(ROWS)
    assert Counter((r["part"], "".join(f for k, f in enumerate("ABCDE") if r["fails"] >> k & 1)) for r in rows) == Counter(want)
    marks = [(p, f, i in (3, 8), i in (3, 4)) for (p, f), (i, _, _) in zip(want, ROWS)]
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
                                                      r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(failed).collect()}
    assert got == brute_audit(marks)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(none, labels)).count() == 0


@pytest.mark.parametrize("size,hashed", [(1, F.xxhash64), (40, F.octet_length), (1 << 20, F.octet_length), (1 << 20, F.xxhash64)])
def test_matrix_is_the_counts_of_words(spark, size, hashed):
    docs = spark.createDataFrame([r for r in ROWS if r[2] != LONG], DOCS).repartition(3)
    shards = doc_term.shard_rows(docs, ["doc_id", "text"], size=size)
    ids = doc_term.dictionary(shards, hashed).checkpoint()
    word = {r["id"]: bytes(r["word"]) for r in ids.where("word is not null").collect()}
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)

    def rows(rows, entries, ids, counts):
        import numpy as np
        import pyarrow as pa
        at = np.concatenate([[0], np.cumsum(entries)]).tolist()
        lists = [list(zip(ids[a:b].tolist(), counts[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
        return pa.table([rows.flatten()[1], pa.array([[{"id": i, "n": n} for i, n in x] for x in lists], kind)], names=["text", "cells"])
    got = doc_term.encoded(shards, ids, rows, "text string, cells array<struct<id: long, n: long>>").collect()
    assert len(got) == len(ROWS) - 1
    for r in got:
        assert {word[c["id"]]: c["n"] for c in r["cells"]} == Counter((r["text"] or "").encode().split())


# --- substring dedup ---

def brute_repeats(rows, window=20):
    first = {}
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    for k, (i, w) in enumerate(rows):
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            place = (i is None, i or 0)
            if key not in first or place < first[key]:
                first[key] = place
    out = []
    for i, w in rows:
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if first[key] < (i is None, i or 0) or key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


def found_repeats(df):
    rows = df.collect()
    for r in rows:
        assert sum(x["end"] - x["first"] for x in r["removed"]) == r["n_removed"]
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows)


def texts_of(seed):
    """Texts over few words with copies, shifted passages, runs and periods."""
    rng = random.Random(seed)
    few, many = [f"w{i}" for i in range(3)], [f"v{i}" for i in range(400)]
    passages = [[rng.choice(many) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    passages += [rng.choices(few, k=rng.randint(1, 4)) * rng.randint(5, 30) for _ in range(6)] + [["a"] * 45, ["a", "a", "b"] * 20]
    out = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            words += p[a:len(p) - rng.randint(0, len(p) // 3)] if rng.random() < 0.7 else rng.choices(many, k=rng.randint(0, 30))
        out.append((i, rng.choice([" ", "  ", "\n", "\t \r"]).join(words)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,size", [(1, 200), (2, 5000), (3, 1 << 22), (4, 1)])
def test_repeats_against_every_window(spark, seed, size):
    rows = texts_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows)
    assert any(n for _, _, n, _ in want)
    assert found_repeats(repeats.remove_repeats(df, size=size)) == want


def test_repeats_edges(spark):
    same = " ".join(f"x{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, same), (3, same), (None, same), (None, same + " tail"), (4, LONG[:90_000]), (5, "\n \x0b"), (6, same.upper()), (7, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("id", F.lit("x"))
    assert found_repeats(repeats.remove_repeats(df, size=500)) == brute_repeats(rows)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# --- Merkle manifest ---

COLUMNS = ["doc_id", "lang", "text"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute_manifest(rows, present):
    def leaf(values):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            a = i // 8 * 8
            yield i - a, level[a:i] + level[i + 1:a + 8]
            i //= 8
    parts = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {p: sorted((r for r in rows if r[1] == p), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for p in parts}
    trees = {p: tree([leaf(r) for r in by[p]]) for p in parts}
    top = tree([trees[p][-1][0] for p in parts])
    out = []
    for k, p in enumerate(parts):
        for i, r in enumerate(by[p]):
            path = [*way(trees[p], i), *way(top, k)]
            node = leaf(present(r))
            for place, others in path:
                node = digest("".join(others[:place] + [node] + others[place:]))
            out.append((r[0], leaf(r), trees[p][-1][0], top[-1][0], digest("".join("".join(o) for _, o in path)), node, node == top[-1][0]))
    return Counter(out)


def found_manifest(spark, rows, own):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string") \
        .withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("id", F.lit(2)).repartition(3)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(df, COLUMNS, "lang", "doc_id", {"text": F.when(third, lowered).otherwise(F.col("text"))}, own)
    return Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def tampered(row):
    i, lang, text = row
    return (i, lang, lower(text) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else text)


@pytest.mark.parametrize("own,langs", [(4, 3), (1, 3), (2, 40), (1, 80)])
def test_manifest_against_a_loop(spark, own, langs):
    rng = random.Random(langs)
    rows = [(i, rng.choice([None, "", *[f"l{k}é" for k in range(langs)]]), rng.choice(["Some Text", "lower", None, "", "É"])) for i in range(900)]
    rows += [(1000 + i, "big", f"Big {i}") for i in range(700)]
    assert found_manifest(spark, rows, own) == brute_manifest(rows, tampered)


def test_manifest_edges(spark):
    rows = [(1, "a", "T")] * 30 + [(None, "a", "T"), (None, "a", None), (None, None, None), (1, "a", "u"), (2, "b", LONG)]
    assert found_manifest(spark, rows, 1) == brute_manifest(rows, tampered)
    assert found_manifest(spark, [(9, None, "One")], 4) == brute_manifest([(9, None, "One")], tampered)
    assert not found_manifest(spark, [], 4)


def test_a_changed_row_is_found_and_no_other(spark):
    rows = [(i, "en", f"Text {i}") for i in range(100)]
    got = found_manifest(spark, rows, 1)
    assert {r[0] for r in got if not r[6]} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 0}
