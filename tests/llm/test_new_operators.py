"""Resampling, whitening and substring deduplication against brute force, over whole tables and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumspark.llm import common, debruijn, registry, resampling, whitening
from tests.llm.fixtures import ODD, odd_docs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def few_hot_rows():
    """Keys count as hot from three rows on, so spread joins take both their ways."""
    before = common.HOT_KEYS, common.HOT_ROWS
    common.HOT_KEYS, common.HOT_ROWS = 10**9, 3
    yield
    common.HOT_KEYS, common.HOT_ROWS = before


# --- 11: importance resampling

feature_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def features(text):
    words = feature_words((text or "").translate(LOWER))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def resampled(docs, aims):
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, aims)):
        for x in texts:
            counts.update(map(bucket, features(x)[1]))
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10000)]
    rows = []
    for i, x in docs:
        words, fs = features(x)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op11_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    aims = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = registry.queries()["op11_resampling"](spark, data).select("doc_id", "n_features", "weight", "score", "rank")
    assert order(got.collect()) == order(resampled(docs, aims))


ODD_LINES = [(20, "Alpha beta\n\n \t\n--\nGAMMA delta alpha beta\nx"), (21, "alpha beta\nalpha beta\nalpha beta"), (22, "éÀ 😀a\n😀a Éà"), (23, "\n".join(["same line of words"] * 500)), (24, "-- \n --")]


def test_op11_odd_inputs(spark, few_hot_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = ODD + [(i, t, None, None, None) for i, t in ODD_LINES]
    docs = spark.createDataFrame(rows, schema).withColumn("rank", F.lit("clash")).withColumn("row", F.lit("clash"))
    aims = spark.createDataFrame([(1, None), (2, "alpha beta words"), (None, "")], "item_id long, text string")

    def run(docs, aims):
        weighed = resampling.weights(docs, aims)
        scored = weighed.withColumn("score", F.col("weight") + resampling.gumbel(F.col("id"), "7"))
        return resampling.drawn(scored, 25, 20).select("id", "n_features", "weight", "score", "rank").collect()

    assert order(run(docs, aims)) == order(resampled([r[:2] for r in rows], [None, "alpha beta words", ""]))
    assert run(docs.limit(0), aims) == []
    assert len(run(docs, aims.limit(0))) == len(rows)


def test_op11_ranks_over_many_ranges(spark):
    rows = [(i, 25, (i * 7919) % 13) for i in range(3000)]
    got = resampling.drawn(spark.createDataFrame(rows, "id long, n_words long, score long"), 25, 20)
    ranks = {r["id"]: r["rank"] for r in got.collect() if r["rank"] is not None}
    want = sorted(rows, key=lambda r: (-r[2], r[0]))[:750]
    assert ranks == {r[0]: k for k, r in enumerate(want, 1)}


# --- 12: whitening


def whitened_rows(vectors, k=8):
    """By vector: deviation and whitened coordinates; and the shares of variance."""
    x = np.array(vectors, np.int64)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [sum(int(y) ** 2 for y in row) for row in n * x - s], c @ v / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(c.T @ c / n)


def test_op12_equals_numpy(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in rows]
    x = [[math.floor(1024 * c) + 100000 for c in r["embedding"]] for r in rows]
    deviation, white, explained = whitened_rows(x)
    got = registry.queries()["op12_whitening"](spark, data).collect()
    assert len(got) == 8 * len(ids)
    at = {i: j for j, i in enumerate(ids)}
    table = np.zeros_like(white)
    for r in got:
        j, k = at[r["vec_id"]], r["component"] - 1
        table[j, k] = r["whitened"]
        assert (r["n"], r["deviation"]) == (len(ids), deviation[j])
        assert math.isclose(r["explained"], explained[k], rel_tol=1e-9) and r["identity_error"] < 1e-9
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * signs).max() < 1e-6


def test_op12_blocks_of_any_size_agree(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-900, 900) + 100000 for _ in range(5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(7)
    deviation, white, _ = whitened_rows([v for _, v in rows])
    for block_bytes in (40, 40 * 9, 10**6):
        got = whitening.whitened(df, "id", "v", 3, block_bytes).collect()
        assert {(r["id"], r["deviation"]) for r in got} == set(enumerate(deviation)) and len(got) == 600
        assert all(math.isclose(abs(r["whitened"]), abs(white[r["id"], r["component"] - 1]), abs_tol=1e-7) for r in got)


def test_op12_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.5, -2.0, 1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, []), (8, [9.0]), (9, [4.0, 4.0, -3.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).withColumn("n", F.lit("clash"))
    ready = lambda df: df.where(whitening.finite(F.col("embedding"))).withColumn("x", whitening.quantised(F.col("embedding"), 1024, 100_000))
    got = whitening.whitened(ready(df), "vec_id", "x").collect()
    kept = [r for r in rows if r[0] in (1, None, 9)]
    deviation, white, explained = whitened_rows([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept])
    k = int((explained > 1e-12).sum())  # three different vectors span two components
    assert k == 2 and len(got) == len(kept) * k
    want = sorted((repr(i), d, round(abs(white[j, c]), 6)) for j, ((i, _), d) in enumerate(zip(kept, deviation, strict=True)) for c in range(k))
    assert sorted((repr(r["vec_id"]), r["deviation"], round(abs(r["whitened"]), 6)) for r in got) == want
    assert max(r["identity_error"] for r in got) < 1e-9
    assert whitening.whitened(ready(df.limit(0)), "vec_id", "x").collect() == []
    assert whitening.whitened(ready(df.where("vec_id = 1")), "vec_id", "x").collect() == []  # equal vectors


# --- 13: substring deduplication


def without_repeats(docs, window=20):
    """doc, text rows to (doc, words, removed, digest); a null doc comes first."""
    key = lambda i: (i is not None, i or 0)
    first, split = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), words in zip(docs, split, strict=True):
        for p in range(len(words) - window + 1):
            w, here = tuple(words[p : p + window]), (key(i), p)
            first[w] = min(first.get(w, here), here)
    out = []
    for (i, _), words in zip(docs, split, strict=True):
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (key(i), p):
                gone[p : p + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def deduplicated(df):
    return df.select("doc_id", "n_words", "n_removed", debruijn.sha256(F.col("kept"))).collect()


def test_op13_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = without_repeats(docs)
    assert sum(r[2] for r in want) > 1000
    got = registry.queries()["op13_substring_dedup"](spark, data).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert order(got.collect()) == order(want)


@pytest.mark.parametrize("seed", range(4))
def test_op13_branching_paths(spark, few_hot_rows, seed):
    """Few words, short windows and much repetition: paths branch, end, loop and overlap."""
    rng = random.Random(seed)
    letters = "abcd" if seed % 2 else "ab"
    passages = [[rng.choice(letters) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    texts = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.7 else [rng.choice(letters + "xyz") for _ in range(rng.randint(1, 12))]
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert order(deduplicated(debruijn.without_repeats(df, 6, 3))) == order(without_repeats(texts, 6))


def test_op13_odd_inputs(spark, few_hot_rows):
    passage = " ".join(f"w{i}" for i in range(70))
    more = [(30, passage), (31, f"before {passage}\tafter"), (32, passage.upper()), (33, " ".join(["again"] * 45)), (34, "x " + " ".join(["again"] * 30)), (34, passage), (35, " ".join(f"w{i}" for i in range(19)))]
    rows = ODD + [(i, t, None, None, None) for i, t in more]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.withColumn("t", F.lit("clash")).withColumn("pos", F.lit("clash")).withColumn("kept", F.lit("clash")).withColumn("xs", F.lit("clash"))
    assert order(deduplicated(debruijn.without_repeats(df))) == order(without_repeats([r[:2] for r in rows]))
    assert deduplicated(debruijn.without_repeats(df.limit(0))) == []


def test_op13_edges_within_paths_are_not_expanded(spark):
    """Copies of a long text are one path, not an edge for each word."""
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(2000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    spans = debruijn.repeated_spans(docs).collect()
    assert sorted((r["doc"], [(x["pos"], x["words"]) for x in r["xs"]]) for r in spans) == [(i, [(0, 2000)]) for i in range(1, 5)]
