"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumspark.llm import bpe, chat, decontaminate, lm, near_dup, quality, secrets, toxicity, url_filter, warc
from quorumspark.llm.common import doc_bucket
from tests.llm.fixtures import LONG, ODD, definition, odd_docs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, empty):
    df = docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    back = bpe.decode(bpe.encode(df, definition()), definition()).select("doc_id", "text", "ids", "decoded").collect()
    assert len(back) == len(ODD)
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert all(r["ids"] == [] for r in back if not r["text"])
    assert bpe.encode(empty, definition()).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (5, 0), (99, 1)], "doc_id long, toxic int")
    bucket = doc_bucket(F.col("doc_id"), 4)
    for train in (labels, labels.limit(0)):
        model = toxicity.fit(docs, train, bucket < 2, bucket == 3)
        scores = [r["score"] for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()]
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(empty, toxicity.fit(empty, labels, bucket < 2, bucket == 3)).count() == 0


def test_near_duplicates(docs, empty):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_shingles"] == 0 and r["component_id"] == 1 and r["kept"] for r in by_id[1])
    assert {r["component_id"] for i in (4, 5, 6) for r in by_id[i]} == {4}  # copies, one a repeated row
    assert [r["kept"] for r in by_id[5]] == [False]
    assert near_dup.near_duplicates(empty).count() == 0


def test_quality(docs, empty):
    df = docs.withColumn("measured", F.lit("clash"))
    measured = quality.measure(df)
    judged = quality.judge(measured, quality.references(measured)).collect()
    assert len(judged) == len(ODD)
    assert all(not r["verdict"]["kept"] and r["verdict"]["base_failed"] for r in judged if not r["text"])
    m = quality.measure(empty)
    assert quality.judge(m, quality.references(m)).count() == 0


def test_lm(docs, empty):
    bucket = doc_bucket(F.col("doc_id"), 10)
    got = lm.score(docs, bucket != 0, bucket == 1).collect()
    assert len(got) == len(ODD)
    assert all(r["n_tokens"] >= 1 and r["score"] <= 0 and r["base_score"] < 0 for r in got)
    assert lm.score(empty, bucket != 0, bucket == 1).count() == 0
    untrained = lm.score(docs, F.lit(False), F.lit(False)).collect()  # no training tokens
    assert {r["train_tokens"] for r in untrained} == {0} and all(r["n_known"] == 0 for r in untrained)


def test_secrets(docs, empty):
    df = docs.withColumn("spans", F.lit("clash"))
    assert all(r["spans"] == [] for r in secrets.scan(df).collect() if not r["text"])
    assert secrets.scan(empty).count() == secrets.redact(empty).count() == 0
    assert secrets.redact(docs).count() == len(ODD)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, LONG), (3, LONG[:200]), (4, LONG[:200])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs.withColumn("item_id", F.lit(1)), items).collect()}
    assert got == {(9, 3), (9, 4)}
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_url_filter(spark):
    day = datetime.date
    events = spark.createDataFrame(
        [("l", "host", "bad.org", "add", day(2024, 1, 1)), ("l", "host", "bad.org", "remove", day(2024, 2, 1)), ("l", "host", "bad.org", "add", day(2024, 2, 1)), ("l", None, None, "add", day(2024, 1, 1)), ("m", "prefix", "ok.org/a/", "add", day(2024, 1, 1)), ("m", "prefix", "ok.org/a/", "add", day(2024, 1, 5))],
        "list string, kind string, pattern string, action string, at date",
    )
    rows = [(1, "http://x.BAD.org/p", day(2024, 1, 1)), (1, "http://x.BAD.org/p", day(2024, 1, 1)), (2, "http://bad.org", day(2024, 2, 1)), (3, "https://notbad.org/", day(2024, 1, 2)), (4, None, day(2024, 1, 2)), (5, "nonsense", None), (6, "http://ok.org/a/b?c=/d/", day(2024, 6, 1)), (7, "http://ok.org/ab", day(2024, 6, 1)), (None, "", day(2024, 6, 1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("lists", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["n_active"], ",".join(r["lists"])) for r in url_filter.filter_captures(captures, events).collect())
    assert got == [(0, 0, ""), (1, 1, "l"), (1, 1, "l"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 1, "m"), (7, 0, "")]
    assert url_filter.filter_captures(captures, events.limit(0)).count() == len(rows)
    assert url_filter.filter_captures(captures.limit(0), events).count() == 0


def test_chat(spark):
    turns = "pair long, turn int, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, 0, None, None, "x"), (2, 0, None, None, "x"), (3, 0, "user", "only here", "x"), (None, 0, "user", "a", "x")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "c", "x"), (1, 2, "user", "d", "x"), (2, 0, None, None, "x"), (None, 0, "user", "a", "x")], turns)
    got = {r["pair"]: r for r in chat.format_preferences(chat.pair_up(chosen, rejected, "pair")).collect()}
    assert set(got) == {1, 2}
    assert got[1]["prompt"] == "<|im_start|>user\na<|im_end|>\n"
    assert got[1]["chosen_text"] == "<|im_start|>assistant\nb<|im_end|>\n"
    spans = [(s["start"], s["end"]) for s in got[1]["rejected_mask"]]
    assert [got[1]["rejected_text"][a:b] for a, b in spans] == ["c<|im_end|>\n"]
    assert (got[2]["n_common"], got[2]["rejected_text"], got[2]["chosen_mask"]) == (1, "", [])
    assert chat.format_preferences(chat.pair_up(chosen.limit(0), rejected, "pair")).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (3, "http://b/c", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "lone"), (7, "u", LONG * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, str(tmp_path / "a"), records_per_archive=5)
    got = {(r["metadata"]["page_id"], r["response"]["record_type"], r["metadata"]["refers_to"], r["metadata"]["payload_bytes"]) for r in warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect()}
    assert got == {(1, "revisit", 3, 4), (2, "revisit", 3, 4), (3, "response", None, 4), (4, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 16), (None, "response", None, 4), (7, "response", None, len(LONG) * 20)}
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_records(spark, str(tmp_path / "b")).count() == 0
    warc.write_archives(pages, str(tmp_path / "c"), min_payload=5)
    kinds = {r["metadata"]["page_id"]: r["response"]["record_type"] for r in warc.assemble(warc.read_records(spark, str(tmp_path / "c"))).collect()}
    assert kinds[1] == kinds[4] == "response"


def test_warc_of_others_and_broken_ones(spark, tmp_path):
    """Long HTTP headers, blocks without end, records without length, stray lines, and truncated archives."""
    record = lambda kind, block, *more: "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    body = b"\x00\xffpayload\r\n\r\nWARC/1.0\r\n\r\n"
    response = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 9000 + b"\r\n\r\n" + body
    good = record("response", response, "WARC-Record-ID: <a>")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(record("warcinfo", b"", "WARC-Record-ID: <i>")) + gzip.compress(b"stray\r\nlines\r\n\r\n" + good))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n" + record("response", b"no headers", "WARC-Record-ID: <b>") + good[:-200]))
    noise = bytes(random.Random(1).randbytes(200_000)).replace(b"\n", b"")
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(good + record("resource", noise, "WARC-Record-ID: <c>"))[:-5000])
    rows = warc.read_records(spark, str(tmp_path)).collect()
    got = Counter((r["archive"].rsplit("/", 1)[1][0], r["record_type"], r["record_id"], r["error"]) for r in rows)
    end = "the archive ends within a record"
    assert got == {
        ("x", "response", "<a>", None): 2, ("x", "warcinfo", "<i>", None): 1, ("x", None, None, "no record begins here"): 1,
        ("y", None, None, "no valid Content-Length"): 1, ("y", "response", "<b>", "no end of the HTTP headers"): 1, ("y", None, None, end): 1,
        ("z", "response", "<a>", None): 1, ("z", None, None, end): 1,
    }
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert all((r["payload_digest"], r["payload_bytes"], r["digest_ok"]) == (digest, len(body), False) for r in rows if r["record_id"] == "<a>")
    assert warc.assemble(warc.read_records(spark, str(tmp_path))).count() == 2


def test_no_archive_is_lost(spark, tmp_path):
    """Archives of which nothing can be read give a row each, empty ones none."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"text {i} " * 50) for i in range(20)], "page_id long, url string, html string").repartition(4)
    warc.write_archives(pages, str(tmp_path / "a"))
    archives = sorted((tmp_path / "a").glob("*.gz"))
    raw = archives[0].read_bytes()
    archives[0].write_bytes(b"broken" + raw[6:])
    for name, data in (("text", b"WARC/1.1\r\n\r\n"), ("cut", raw[:12]), ("empty", gzip.compress(b""))):
        (tmp_path / "a" / f"{name}.warc.gz").write_bytes(data)
    rows = warc.read_records(spark, str(tmp_path / "a")).collect()
    lost = {r["archive"].rsplit("/", 1)[1].split(".")[0] for r in rows if r["error"] == "nothing of the archive can be read"}
    assert lost == {archives[0].name.split(".")[0], "text", "cut"} and all(r["record_type"] is None for r in rows if r["error"])
    left = warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).count()
    assert 0 < left < 20 and sum(r["record_type"] == "response" for r in rows) == left


def test_warc_without_broadcast(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(300)], "page_id long, url string, html string")
    both = []
    for bound in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        warc.write_archives(pages, str(tmp_path / str(bound)))
        both.append({(r["metadata"]["page_id"], r["response"]["record_type"], r["metadata"]["refers_to"]) for r in warc.assemble(warc.read_records(spark, str(tmp_path / str(bound)))).collect()})
    assert both[0] == both[1] and len(both[0]) == 300 and (1, "revisit", 299) in both[0]


#: Names that operators might use inside.
CLASHES = ["kept", "base_failed", "measured", "verdict", "__words", "__rest", "__lang", "ref_common", "ref_classes", "__url", "__at", "key", "ids", "n", "n_tokens", "rep", "root", "grp", "node", "hash", "words", "spans", "score", "sig", "block", "part", "copies", "hot", "toxic", "digest", "id", "first", "value", "__kept", "__rows", "turns", "n_common"]


def clashing(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHES if c not in df.columns))


@pytest.fixture(scope="module")
def hard(spark, data):
    """Odd documents and ordinary ones, one of them of 5 MB, with columns named like those inside operators."""
    plain = spark.read.parquet(f"{data}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    huge = spark.createDataFrame([(500, LONG * 30, "en", "s", 1)], SCHEMA)
    return clashing(spark.createDataFrame(ODD, SCHEMA).unionByName(plain).unionByName(huge)).cache()


def test_pipeline_stages_on_hard_documents(spark, data, hard):
    before = hard
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data).cache()
        if name == "tokenization":
            assert set(after.columns) == set(hard.columns) - {"text"}
        else:
            assert after.columns == hard.columns
        assert after.count() == before.count() if name in ("secret_scan", "tokenization") else after.count() <= before.count()
        untouched = [c for c in CLASHES if c not in ("ids", "n_tokens")]
        assert after.where(" or ".join(f"`{c}` <> 'mine'" for c in untouched)).isEmpty()
        given = {tuple(r) for r in hard.select("doc_id", "lang", "source").collect()}
        assert {tuple(r) for r in after.select("doc_id", "lang", "source").collect()} <= given
        before = after
    for name, stage in corpus_pipeline.STAGES:  # each by itself, and on nothing
        assert stage(spark, hard, data).count() > 0
        assert stage(spark, hard.limit(0), data).count() == 0
        nulls = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
        assert stage(spark, nulls, data).count() == (0 if name == "quality_rules" else 3)


def test_operators_on_hard_documents(spark, hard):
    n = hard.count()
    bucket = doc_bucket(F.col("doc_id"), 4)
    labels = clashing(hard.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int"))).drop("toxic").withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    model = toxicity.fit(hard, labels, bucket < 2, bucket == 3)
    items = clashing(spark.createDataFrame([(1, LONG[:300]), (2, None)], "item_id long, text string"))
    m = quality.measure(hard, out="m")
    results = {
        "toxicity": toxicity.score(hard, model), "bpe": bpe.encode(hard, definition()), "near_dup": near_dup.near_duplicates(hard), "quality": quality.judge(m, quality.references(m, column="m"), column="m", out="v"),
        "lm": lm.score(hard, bucket != 0, bucket == 1), "secrets": secrets.scan(hard, known=secrets.vocabulary(hard)),
    }
    for name, df in results.items():
        assert df.count() == n, name
        replaced = {"toxicity": "score", "bpe": "ids", "secrets": "spans"}.get(name)
        stay = [c for c in CLASHES if c in df.columns and c != replaced and name not in ("near_dup", "lm")]
        assert df.where(" or ".join(["false", *(f"`{c}` <> 'mine'" for c in stay)])).isEmpty(), name
    assert {r["doc_id"] for r in decontaminate.contamination(hard, items).collect()} == {9, 500}


def test_url_filter_on_hard_captures(spark):
    day = datetime.date
    events = clashing(spark.createDataFrame([("l", "host", "bad.org", "add", day(2024, 1, 1))], "list string, kind string, pattern string, action string, at date"))
    rows = [(1, "http://bad.org/" + "a/" * 2000, day(2024, 2, 1)), *[(2, "http://bad.org/", day(2024, 2, 1))] * 300, (3, "http://good.org/", day(2024, 2, 1)), (4, None, None)]
    captures = clashing(spark.createDataFrame(rows, "page_id long, url string, fetched_on date"))
    got = url_filter.filter_captures(captures, events)
    assert got.columns == [*captures.columns, "n_active", "lists"]
    assert Counter((r["page_id"], r["n_active"]) for r in got.collect()) == {(1, 1): 1, (2, 1): 300, (3, 0): 1, (4, 0): 1}
    assert got.where(" or ".join(f"`{c}` <> 'mine'" for c in CLASHES)).isEmpty()


def test_list_snapshots(spark):
    day = datetime.date
    rows = [("l", "host", p, day(2024, m, 1)) for m, ps in ((1, "ab"), (2, "b"), (4, "abc"), (5, "c")) for p in ps] + [("l", "host", "a", day(2024, 1, 1)), ("k", None, "x", day(2024, 3, 1)), ("l", "host", None, day(2024, 3, 1))]
    got = {(r["list"], r["pattern"], r["action"], r["at"].month) for r in url_filter.listed_changes(spark.createDataFrame(rows, "list string, kind string, pattern string, at date")).collect()}
    assert got == {("l", "a", "add", 1), ("l", "b", "add", 1), ("l", "a", "remove", 2), ("l", "a", "add", 4), ("l", "c", "add", 4), ("l", "a", "remove", 5), ("l", "b", "remove", 5), ("k", "x", "add", 3)}


def test_chat_on_hard_turns(spark):
    turns = "pair long, turn int, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", LONG * 30), (2, 0, "user", "only"), (3, 0, None, None)]
    both = clashing(spark.createDataFrame(rows, turns))
    pairs = chat.pair_up(both, both.withColumn("text", F.when(F.col("role") == "assistant", "no").otherwise(F.col("text"))), "pair")
    got = {r["pair"]: r for r in chat.format_preferences(clashing(pairs)).collect()}
    assert {k: r["trainable"] for k, r in got.items()} == {1: True, 2: False, 3: False}
    assert len(got[1]["chosen_text"]) > 30 * len(LONG) and got[1]["kept"] == "mine" and got[1]["n_common"] == 1
    assert chat.format_preferences(pairs.limit(0)).count() == 0
