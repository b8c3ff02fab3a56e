"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import ann, bpe, chat, lm, mixing, ngram_join, quality, topk, urlfilter, warc
from ledgerlake.llm.queries import RANKS, RULES
from ledgerlake.session import checkpoint_path

DOCS = "doc_id long, text string, source string"
LONG = "lorem ipsum dolor " * 60_000
ROWS = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six", None), (3, "one two three four five six", None),
        (None, "one two three four five six", "b"), (5, LONG, "b"), (6, " \n\t ", None), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe(spark, docs, none):
    clash = docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    back = bpe.decode(bpe.encode(clash, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = back.collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["text"] or "").encode() for r in rows) == sorted(bytes(r["decoded"]) for r in rows)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([65, None],), ([10**9],), ([65],)], "ids array<int>")
    assert [r["decoded"] is None for r in bpe.decode(odd, RANKS).collect()] == [True, False, True, True, False]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(docs.withColumn("score", F.lit("x")).withColumn("pooled", F.lit(0)), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_join(docs, none):
    rows = ngram_join.join_components(docs.withColumn("n", F.lit(0)).withColumn("node", F.lit(0)), 3, 90).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 4, 3), (3, 4, 3), (-1, 4, 3), (5, 3, 5), (6, 0, 6), (-1, 0, -1)])
    assert ngram_join.join_components(none).count() == 0


def test_language_model(docs, none):
    rows = lm.score_texts(docs.withColumn("row", F.lit(1)).withColumn("key", F.lit(2)), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 1, 7, 7, 7, 180_001]
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert lm.score_texts(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_language_model_sums_to_one():
    kinds = np.array([0, 1, 1, 2, 0, 3])
    model = lm.Attention(kinds)
    counts = np.array([5., 1, 2, 9, 0, 3])
    pairs = (np.array([1 * 6 + 2, 1 * 6 + 1, 3 * 6 + 2]), np.array([4, 1, 2]))
    triples = (np.array([(3 * 6 + 1) * 6 + 2]), np.array([2]))
    within = lm.Within(kinds, counts, pairs, triples)
    for before in ([], [1], [3], [3, 1], [0, 3]):
        total = 0.0
        for i in range(6):
            word = np.array([*before, i])
            whole = within.logs(word, np.array([len(word)]))[0]
            prefix = within.logs(np.array(before, int), np.array([len(before)]))[0] if before else 0
            ids = np.array([5, *before, i])
            classes = lm.score(model.ready(), ids, np.array([0, len(ids)]))[0]
            earlier = lm.score(model.ready(), ids[:-1], np.array([0, len(ids) - 1]))[0] if before else 0
            total += 10 ** (whole - prefix + classes - earlier)
        assert total == pytest.approx(1, abs=1e-5)


def test_windows_score_each_id_once():
    starts = np.array([0, 2, 50, 51 + 200])
    at, first, stop = lm.windows(starts)
    new = [p for a, s, e in zip(at, first, stop) for p in range(a + lm.CONTEXT, a + lm.CONTEXT + lm.STRIDE) if p < e]
    assert new == [p for a, b in zip(starts, starts[1:]) for p in range(a, b - 1)]


def test_mix(docs, none):
    rows = mixing.mix(docs.withColumn("mix_slot", F.lit("x")), {"a": 2, "": 3}, 1, 2).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in rows] == list(range(len(ROWS)))
    assert mixing.mix(none, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


VECTORS = [(0, [1.0, 0.0, 0.0]), (20, [0.5, 0.5, 0.0]), (40, None), (50, [0.0, 0.0, 0.0]), (60, [float("nan"), 1.0, 1.0]),
           (80, [None, 1.0, 1.0]), (100, [-1.0, 0.0, 2.0]), (100, [-1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 0.0]),
           (8, [0.5, 0.5, 0.0]), (9, [])]


def test_nearest(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("bucket", F.lit(2))
    got = [tuple(r)[:3] for r in ann.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8), (0, 2, 20), (20, 1, 8), (20, 2, 0), (100, 1, 8), (100, 2, 20)]
    assert ann.nearest_neighbours(rows.limit(0), rows.limit(0)).count() == 0


def test_top_products(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("pivot", F.lit(1)).withColumn("floor", F.lit(2))
    got = [tuple(r) for r in topk.top_products(rows, rows.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 2048), (0, 2, 20, 2048), (0, 3, 50, 0), (20, 1, 0, 2048), (20, 2, 8, 2048), (20, 3, 50, 0),
                   (100, 1, 50, 0), (100, 2, 8, -2048), (100, 3, 20, -2048)]
    assert topk.top_products(rows.limit(0), rows.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-3.0, 5.0])], "vec_id long, embedding array<double>")
    got = topk.top_products(huge, huge.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (2, -2**63)]


def test_dual_tree_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (12, 16))
    rows = (centres[rng.integers(0, 12, 3000)] + rng.integers(-9, 9, (3000, 16))).astype(float)
    rows[:50] = rows[0]
    ids = rng.permutation(3000)
    q = rows[::7]
    got = topk.dual_tree(q, rows, ids[::7], ids, 5, np.full(len(q), -np.inf))
    scores = (q @ rows.T).astype(int)
    for line, own, s in zip(got, ids[::7], scores):
        want = sorted(((-v, i) for v, i in zip(s, ids) if i != own))[:5]
        assert sorted((-a, b) for a, b in line) == want


def test_warc(spark, tmp_path):
    body = "x" * 200
    pages = spark.createDataFrame([(3, "http://a/", body), (1, "http://a/", body), (2, None, None), (4, "u\r\nv", "short"), (5, "", "short"),
                                   (1, "http://a/", body), (6, "http://a/", "ü\r\n\r\nWARC/1.1 " * 20)], "page_id long, url string, html string")
    path = warc.write_archive(pages.withColumn("digest", F.lit("x")), checkpoint_path(spark, "warc-test-" + tmp_path.name))
    rows = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archive(spark, path).collect()}
    assert rows == {(1, "response", None, 200), (3, "revisit", "1", 200), (2, "response", None, 0), (4, "response", None, 5),
                    (5, "response", None, 5), (6, "response", None, len(("ü\r\n\r\nWARC/1.1 " * 20).encode()))}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {r["record_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, path).collect()}
    assert records[6].endswith(("ü\r\n\r\nWARC/1.1 " * 20).encode() + b"\r\n\r\n") and records[6].startswith(b"WARC/1.1\r\n")
    assert b"Content-Length: 0\r\n" in records[3] and b"WARC-Refers-To: <urn:page:1>" in records[3]
    empty = warc.write_archive(pages.limit(0), checkpoint_path(spark, "warc-none-" + tmp_path.name))
    assert warc.read_archive(spark, empty).count() == 0


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "|im_end|>", "<", "a<|im_start|>assistant<|im_sep|>b", None, "", "日本\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "us<|er", t) for i, t in enumerate(nasty)] + [(None, 0, None, "x"), (1, 3, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    done = chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                                chat.read_learned(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == 1))
    assert [(t["role"], t["content"]) for t in got[1]["t"]] == [(r, c) for _, r, c in want]
    assert got[1]["l"] == [c for _, r, c in want if r == "assistant"]
    assert [(t["role"], t["content"]) for t in got[None]["t"]] == [("", "x")]
    assert chat.format_chat(turns.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = ("array(named_struct('type','text','text','a<','ref',null,'units',null), named_struct('type','text','text','|b','ref',null,'units',null),"
             "named_struct('type','image','text',null,'ref','i.png','units',1000), null, named_struct('type','audio','text',null,'ref','s.wav','units',81),"
             "named_struct('type','document','text',null,'ref','d.pdf','units',null), named_struct('type',null,'text',null,'ref',null,'units',null))")
    turns = spark.range(1).selectExpr("id as conv_id", "0 as turn", "'user' as role", f"cast({parts} as {chat.PART_TYPE.join(['array<', '>'])}) as parts")
    r = chat.format_chat(turns).first()
    assert r["formatted"] == "<|im_start|>user<|im_sep|>a<<|part|>|b<|image|><|audio|><|document|><|im_end|>"
    assert [(f["place"], f["type"], f["ref"], f["tokens"]) for f in r["attachments"]] == \
        [(0, "image", "i.png", 2), (1, "audio", "s.wav", 3), (2, "document", "d.pdf", 1)]
    assert r["expanded_tokens"] == 6 and r["loss_spans"] == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "x://a.Example.com/en/x?y", "http://www.example.com/en/",
            "http://www.example.com/EN/", "http://b.net/fr/#z", "http://net/fr", "http://xnet/fr/", "a://b://net/es/", "http://com:80/", "http://com/\nx"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("rule", F.lit(5))
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, RULES).collect()}
    assert got[None] == got[""] == got["no scheme"] == ("", "", None, "allow")
    assert got["http://COM"] == ("com", "", None, "allow") and got["http://com/"][2] == "com/"
    assert got["x://a.Example.com/en/x?y"] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got["http://www.example.com/en/"][2:] == ("www.example.com/en/", "allow")
    assert got["http://www.example.com/EN/"][2] == "com/" and got["http://b.net/fr/#z"][2:] == ("net/fr/", "block")
    assert got["http://net/fr"][2] is None and got["http://xnet/fr/"][2] is None and got["http://com:80/"][2] is None
    assert got["a://b://net/es/"][:2] == ("b:", "//net/es/") and got["http://com/\nx"][1:3] == ("/\nx", "com/")
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_rules_are_found_by_their_rarest_token():
    rng = np.random.default_rng(1)
    labels, paths = ["a", "bb", "c-d", "e_f", "x9"], ["", "/", "/p", "/p/", "/p/q", "/ü/", "/p%20/"]
    rules = [urlfilter.Rule(str(rng.choice(["allow", "block"])), ".".join(rng.choice(labels, rng.integers(0, 4))), str(rng.choice(paths)))
             for _ in range(60)]
    index = urlfilter.RuleIndex(rules)
    for _ in range(2000):
        host, path = ".".join(rng.choice(labels, rng.integers(0, 4))), str(rng.choice(paths)) + str(rng.choice(["", "q", "/q/r"]))
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text), default=None)
        assert index.judge(host, path) == ((best.text, best.verdict) if best else (None, None))


def test_language_model_counts_all_pairs_and_triples(spark, monkeypatch):
    """Over 200,000 different triples of ids inside words, and every one counts."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéß日"))
    texts = [" ".join("".join(rng.choice(letters, 14)) for _ in range(60)) + " aaaaaaaaaaaaaaaaaaaaaa the the" for _ in range(700)]
    rows = list(enumerate(texts))
    fitted, models = lm._fitted, []
    monkeypatch.setattr(lm, "_fitted", lambda *a: models.append(fitted(*a)) or models[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, RANKS, public_tokenizers.PATTERN).collect()}
    with open(RANKS, "rb") as f:
        subwords = lm.Subwords(f.read(), public_tokenizers.PATTERN)
    size, model = subwords.end + 1, models[0]
    counts, tables = np.zeros(size), [Counter(), Counter()]
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts[-1] += 1
            for word in text.split():
                ids = subwords.encode(" " + word)
                np.add.at(counts, ids, 1)
                tables[0].update(a * size + b for a, b in zip(ids, ids[1:]))
                tables[1].update((a * size + b) * size + c for a, b, c in zip(ids, ids[1:], ids[2:]))
    assert len(tables[1]) > 200_000
    within = lm.Within(model.kinds, counts, *[(np.array(list(t)), np.array(list(t.values()))) for t in tables])
    words = lm.Words(pa.array(texts))
    flat = words.flat(subwords)
    want = lm.score(model.ready(), *words.sequences(subwords, flat))
    want += np.add.reduceat(within.logs(*flat)[words.own], words.first[:-1])
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i, _ in rows)


def test_repeated_ids_take_one_place(spark, monkeypatch):
    """Copies of the best neighbours, equal or not, take no place of others; one id has a third of all rows."""
    monkeypatch.setattr(topk, "ROWS_PER_PIVOT", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "ROW_CHUNK", 50)
    monkeypatch.setattr(ann, "ROW_CHUNK", 50)
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.integers(-9, 9, 4).astype(float).tolist()) for i in rng.integers(0, 40, 120)]
    rows += [(77, (rng.integers(20, 30, 4)).astype(float).tolist()) for _ in range(40)] + [(78, [29.0] * 4)] * 40
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def expected(k, score):
        found = {}
        for q, a in rows:
            if q % 5 == 0:
                for i, b in rows:
                    if i != q:
                        found.setdefault(q, {})[i] = max(score(a, b), found.get(q, {}).get(i, -np.inf))
        return {q: sorted(((-round(s, 9), i) for i, s in best.items()))[:k] for q, best in found.items()}

    def collected(df):
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        return got

    asked = df.where("vec_id % 5 = 0")
    assert collected(topk.top_products(df, asked, 20, 1.0)) == expected(20, lambda a, b: int(np.dot(a, b)))
    cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    assert collected(ann.nearest_neighbours(df, asked, 7)) == expected(7, cosine)
    big = spark.createDataFrame([(0, [1e17]), (1, [1e17]), (1, [2e17]), (1, [3e17]), (2, [5.0])], "vec_id long, embedding array<double>")
    got = topk.top_products(big, big.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]


def test_pipeline_returns_the_order_of_the_mix(spark, small_dir, monkeypatch):
    """mix_position of run()'s rows is the mix's, though files are reread in another order."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("mixing", "byte-level BPE")])
    got = {r["doc_id"]: r["mix_position"] for r in corpus_pipeline.run(spark, small_dir).select("doc_id", "mix_position").collect()}
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    mixed = mixing.mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.OTHER_WEIGHT, corpus_pipeline.BLOCK_ROWS).collect()
    assert got == {r["doc_id"]: r["mix_position"] for r in mixed}


def test_places_follow_file_names(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text").repartitionByRange(7, "doc_id") \
        .sortWithinPartitions("doc_id").write.parquet(path)
    rows = corpus_pipeline.placed(spark, spark.read.parquet(path)).collect()
    assert len(rows) == 1000 and all(r["mix_position"] == r["doc_id"] for r in rows)
    assert corpus_pipeline.placed(spark, spark.read.parquet(path).where("doc_id < 0")).count() == 0


def test_pipeline_keeps_one_row_of_a_group_whatever_its_ids(spark, tmp_path):
    """Near copies without an id, and rows that repeat an id, go like all others."""
    words = [f"w{i}" for i in range(200)]
    text, near = " ".join(words), " ".join([*words, "more"])
    other = " ".join(reversed(words))
    rows = [(7, text, 1), (None, near, 2), (None, text, 3), (4, near, 4), (4, text, 5), (4, other, 6), (None, other, 7),
            (8, None, 8), (9, "", 9), (None, " ", 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _place int")
    kept = lambda df: sorted(r["_place"] for r in corpus_pipeline.one_of_each_group(spark, df, "").collect())
    path = str(tmp_path / "rows")
    frame.coalesce(1).write.parquet(path)
    for df in (frame, spark.read.parquet(path)):
        got = kept(df)
        assert got[0] in (4, 5) and got[1:] == [6, 8, 9, 10]
        assert corpus_pipeline.one_of_each_group(spark, df, "").columns == frame.columns
    assert corpus_pipeline.one_of_each_group(spark, frame.limit(0), "").count() == 0


def slow_schedule(sizes, weights):
    """Slot by slot: of the released blocks the one due first, by name if several are; anew when a source runs out."""
    left, out = dict(sizes), []
    while left:
        total, taken, now = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0
        while min(left[s] - taken[s] for s in left):
            ready = [(-(-(taken[s] + 1) * total // weights[s]), s) for s in left if taken[s] * total // weights[s] <= now]
            s = min(ready)[1]
            out.append((s, taken[s]))
            taken[s] += 1
            now += 1
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
    return [s for s, _ in out]


@pytest.mark.parametrize("sizes,weights,block", [
    ({"+a": 41, "+b": 17, "-": 9, "+c": 1}, {"a": 5, "b": 2, "": 3, "c": 2}, 4),
    ({f"+s{i:02}": 3 + i % 7 for i in range(40)}, {f"s{i:02}": 4 for i in range(40)}, 2)])
def test_mix_is_the_earliest_deadline_schedule(spark, sizes, weights, block):
    """Row by row equal to a loop over slots, with input columns that bear internal names."""
    names = "_s _i _gap _p _m _first _t _b _w _d _h _o0 _row _start".split()
    rows = [(k, None if s == "-" else s[1:], *[f"{n}{k}" for n in names])
            for s, count in sizes.items() for k in range(sum(map(ord, s)) * 1000, sum(map(ord, s)) * 1000 + count)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(df, weights, 1, block).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows)))
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    of = {s: sorted(r[0] for r in rows if r[1] == (None if s == "-" else s[1:])) for s in sizes}
    want, at = [], dict.fromkeys(sizes, 0)
    for s in slow_schedule({s: -(-n // block) for s, n in sizes.items()}, {s: weights[s[1:]] for s in sizes}):
        want += of[s][at[s]:at[s] + block]
        at[s] += block
    assert [r["doc_id"] for r in got] == want


def test_many_equal_sources_mix():
    """Weights are divided by their common divisor: 1000 sources of weight 4 take turns."""
    parts, pattern = mixing.phases({f"s{i:04}": 1 + i % 5 for i in range(1000)}, {f"s{i:04}": 4 for i in range(1000)})
    assert sum(end - first for _, _, first, end, *_ in parts) == 3000 and len(pattern) <= mixing.MAX_PATTERN


def test_language_model_does_not_depend_on_partitions(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 120").collect()
    scores = []
    for order, parts in ((docs, 1), (docs[::-1], 5)):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        rows = lm.score_texts(df, RANKS, public_tokenizers.PATTERN).collect()
        scores.append({r["doc_id"]: r["score"] for r in rows})
    assert scores[0].keys() == scores[1].keys()
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)
