"""Replaced tables, exports, deliveries, use counts, status machines and redaction: odd inputs, failures and brute force."""

from __future__ import annotations

import csv
import datetime
import http.server
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quorumspark.operators import exports as X
from quorumspark.operators import machines as M
from quorumspark.operators import redaction as R
from quorumspark.operators import reports
from quorumspark.operators import snapshots
from quorumspark.operators import usage as U
from quorumspark.streaming import outbox as O


# --- tables replaced as a whole


def test_a_write_that_fails_midway_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert snapshots.replace(spark.range(100), path) == 1
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("midway"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="midway"):
        snapshots.replace(broken, path)
    assert snapshots.current(spark, path).count() == 100
    assert snapshots.replace(spark.range(5), path) == 2
    assert snapshots.current(spark, path).count() == 5


def test_a_table_is_replaced_from_itself_and_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "table")
    snapshots.replace(spark.range(10), path)
    before = snapshots.current(spark, path)
    snapshots.replace(before.where("id % 2 = 0"), path)
    assert (before.count(), snapshots.current(spark, path).count(), snapshots.current(spark, path, version=1).count()) == (10, 5, 10)
    snapshots.vacuum(spark, path)
    assert sorted(snapshots.versions(spark, path)) == [2] and snapshots.current(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path, version=1)
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, str(tmp_path / "none"))


def test_writers_at_one_time_get_numbers_of_their_own(spark, tmp_path):
    path, got = str(tmp_path / "table"), []
    work = [threading.Thread(target=lambda n=n: got.append(snapshots.replace(spark.range(n), path))) for n in (1, 2, 3)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(got) == [1, 2, 3] == sorted(snapshots.versions(spark, path))


# --- exports


def test_export_is_ordered_over_its_files(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'a,"{i}"' if i % 3 == 0 else f"x{i}") for i in range(2000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    path = str(tmp_path / "out")
    X.write_lines(df, [F.col("k")], X.escaped(F.col("k"), F.col("v")), "k,v", path)
    lines = X.read_lines(spark, path).orderBy("n").collect()
    assert [r["n"] for r in lines] == list(range(2001))
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("part") and f.stat().st_size]) > 1
    # one file after the other, as a reader that knows CSV sees them
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").iterdir()) if f.name.startswith("part"))
    assert list(csv.reader(text.splitlines())) == [["k", "v"], *([str(k), v or ""] for k, v in sorted(rows))]


def test_export_of_nothing_has_its_header(spark, tmp_path):
    df = spark.createDataFrame([], "k int, v string")
    X.write_lines(df, [F.col("k")], X.plain(F.col("k"), F.col("v")), "k,v", str(tmp_path / "out"))
    assert [tuple(r) for r in X.read_lines(spark, str(tmp_path / "out")).collect()] == [(0, "k,v")]


def test_cells(spark):
    df = spark.createDataFrame([("a,b", 'say "x"', None)], "a string, b string, c string")
    cells = [F.col(c) for c in "abc"]
    assert df.select(X.plain(*cells), X.escaped(*cells), X.quoted(F.col("b")), X.quoted(F.col("c"))).first()[:] == ('a,b,say "x",', '"a,b","say ""x""",', '"say "x""', '""')


# --- deliveries


class Receiver(http.server.BaseHTTPRequestHandler):
    """Fails the first time for bodies with "again", always for "never", and does not answer in time to "slow"."""

    came: list[tuple] = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        first = not any(b == body for b, _ in Receiver.came)
        Receiver.came.append((body, dict(self.headers)))
        if body == "slow":
            time.sleep(2)
        status = 500 if body == "never" or (body == "again" and first) else 200
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps({"id": 12}).encode() if body != "odd" else b"[]")

    def log_message(self, *_):
        pass


@pytest.fixture
def receiver():
    Receiver.came.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_delivery_by_http(spark, tmp_path, receiver):
    rows = [("1", "fine", "api_key", None), ("2", "again", "bearer", None), ("3", "never", "none", None), ("4", "slow", None, 300), ("5", "odd", "api_key", 0), ("5", "odd", "api_key", 0), (None, "nobody", None, None)]
    c = F.col
    df = spark.createDataFrame(rows, "id string, body string, auth string, timeout_ms long")
    sent = df.select("id", F.lit(receiver).alias("url"), O.headers(c("id"), c("auth"), F.lit("k"), F.lit("t"), F.lit(None).cast("map<string,string>")).alias("headers"), "body", "timeout_ms")
    log = str(tmp_path / "log")
    O.deliver(sent, log, attempts=2)
    got = {r["id"]: r for r in O.outcomes(spark, log).collect()}
    assert {i: (r["attempts"], r["success"], r["execution_id"]) for i, r in got.items()} == {"1": (1, True, "12"), "2": (2, True, "12"), "3": (2, False, None), "4": (2, False, None), "5": (1, True, None)}
    assert got["3"]["error"] == "the receiver returned 500" and "timed out" in got["4"]["error"] and got["2"]["error"] is None
    heads = {b: {k.lower(): v for k, v in h.items()} for b, h in Receiver.came}
    assert heads["fine"]["x-api-key"] == "k" and heads["fine"]["idempotency-key"] == "1" and heads["again"]["authorization"] == "Bearer t" and "authorization" not in heads["never"]
    before = len(Receiver.came)
    O.deliver(sent, log, attempts=2)  # as a batch that runs again
    assert len(Receiver.came) == before
    O.deliver(sent, log, attempts=3)  # one attempt more for what was not answered
    assert sorted(b for b, _ in Receiver.came[before:]) == ["never", "slow"]


# --- use counts


def test_uses_of_keys(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    keys = [("free", True, None, None, 1, t(50)), ("ends", True, t(10), None, 0, None), ("few", True, None, 2, None, None), ("off", False, None, None, 0, None), ("odd", None, None, 1, 0, None), ("full", True, t(10), 3, 5, None), ("idle", True, None, 3, 0, None)]
    uses = [(k, t(s)) for k in ("free", "ends", "few", "off", "odd", "full", "unknown", None) for s in (5, 10, 11)] + [("few", t(5)), ("free", None)]
    got = U.used_keys(spark.createDataFrame(keys, "key string, active boolean, expires_at timestamp, use_limit int, used int, last_used_at timestamp"), spark.createDataFrame(uses, "key string, at timestamp"), "key", "at", F.lit(t(30)))
    assert sorted((r["key"], r["used"], r["last_used_at"], r["refused"], r["state"]) for r in got.collect()) == [
        ("ends", 2, t(10), 1, "expired"), ("few", 2, t(5), 2, "exhausted"), ("free", 4, t(50), 0, "active"), ("full", 5, None, 3, "exhausted"), ("idle", 0, None, 0, "active"), ("odd", 0, None, 3, "inactive"), ("off", 0, None, 3, "inactive"),
    ]


# --- status machines


@pytest.mark.parametrize("chunk", [3, 1024])
def test_machine_equals_a_walk(spark, chunk):
    """A hot key's chunks lie in several tasks, and chain."""
    rng = random.Random(4)
    names = ["start", "complete", "fail", "cancel", "unknown", None]
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i if i % 50 else None, i, rng.choice(names)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, i int, event string").repartition(7).withColumn("after", F.lit("clash")).drop("after")
    got = {r["i"]: (r["before"], r["after"], r["legal"]) for r in M.run_machine(df, "k", ["at", "i"], F.col("event"), M.IMPORT, "pending", chunk).collect()}
    state, want = {}, {}
    for k, at, i, e in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        s = state.get(k, "pending")
        state[k] = M.IMPORT.get((s, e), s)
        want[i] = (s, state[k], (s, e) in M.IMPORT)
    assert got == want
    assert M.run_machine(df.limit(0), "k", ["at"], F.col("event"), M.IMPORT, "pending").count() == 0


def test_load_events(spark):
    rows = [("success",), ("whatever",), (None,), ("error",), ("failed",), ("trigger",)]
    got = spark.createDataFrame(rows, "s string").select(M.load_event(F.col("s"))).collect()
    assert [r[0] for r in got] == ["report", "report", "report", "error", "error", "trigger"]


# --- redaction

NAMES = ["a", "b", "note", "Password", "accessTokens", "my secret", "credential\"s", "AUTHORIZATION", "pass\\word", "token", "é"]


def document(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice(NAMES) + str(rng.randint(0, 99)): document(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.6:
        return [document(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([1, -2.5, True, False, None, "", 'token": "x', "a, {b} [c]", "\\", 'q"q', "password: y", "ü"])


def hidden(x):
    if isinstance(x, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in ("password", "token", "secret", "credential", "authorization")) else hidden(v) for k, v in x.items()}
    return [hidden(v) for v in x] if isinstance(x, list) else x


def test_redaction_equals_a_recursive_walk(spark):
    rng = random.Random(9)
    docs = [document(rng, 6) for _ in range(300)]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 2)) for i, d in enumerate(docs)]
    got = R.redacted_documents(spark.createDataFrame(rows, "i int, m string"), "m").collect()
    assert sum("REDACTED" in r["m"] for r in got) > 50
    assert {r["i"]: json.loads(r["m"]) for r in got} == {i: hidden(d) for i, d in enumerate(docs)}


def test_redaction_of_odd_documents(spark):
    deep = '{"a":' * 200 + '{"token":[[1]]}' + "}" * 200
    rows = [(1, None), (2, ""), (3, "{broken"), (4, '"bare password"'), (5, " 12 "), (6, '{"p\\u0061ssword": {"x": ["}"]}, "y": 1e3}'), (7, deep), (8, "[]")]
    got = {r["i"]: r["m"] for r in R.redacted_documents(spark.createDataFrame(rows, "i int, m string").withColumn("tokens", F.lit("clash")), "m").collect()}
    assert got == {1: None, 2: None, 3: None, 4: '"bare password"', 5: "12", 6: '{"p\\u0061ssword":"[REDACTED]","y":1e3}', 7: deep.replace("[[1]]", '"[REDACTED]"'), 8: "[]"}
    longer = spark.createDataFrame([(json.dumps({"xs": [{"token": i, "v": i} for i in range(3000)]}),)], "m string")
    assert json.loads(R.redacted_documents(longer, "m").first()["m"])["xs"] == [{"token": "[REDACTED]", "v": i} for i in range(3000)]


# --- reports


def test_figures_of_odd_reports(spark):
    y, n, a = "compliant", "non_compliant", "not_applicable"
    votes = [(1, 1, 1, "x", y), (1, 1, 1, "z", n), (1, 1, 1, None, None), (1, 2, 1, "x", a), (2, None, None, "x", a), (3, 1, 1, "x", None), (None, 1, 1, "x", y), (1, 1, 1, "x", y)]
    got = {r["report"]: r for r in reports.report_figures(spark.createDataFrame(votes, "report int, standard int, spec int, reader string, compliance string")).collect()}
    assert {k: (r["total"], r[y], r[n], r[a], r["disagreements"], r["compliance_rate"], r["shares"][y]) for k, r in got.items()} == {
        1: (2, 1, 0, 1, 1, 100, "1 (50%)"), 2: (1, 0, 0, 1, 0, None, "0 (0%)"), 3: (1, 0, 0, 0, 0, 0, "0 (0%)"), None: (1, 1, 0, 0, 0, 100, "1 (100%)"),
    }
    assert [tuple(r) for r in got[1]["readers"]] == [(None, 1, 0, "Y: 0 | N: 0 | N/A: 0"), ("x", 3, 2 + 1, "Y: 2 | N: 0 | N/A: 1"), ("z", 1, 1, "Y: 0 | N: 1 | N/A: 0")]
    assert [(s["standard"], s["total"], [tuple(x) for x in s["lines"]]) for s in got[1]["standards"]] == [(1, 1, [(1, y, "Y: 2 | N: 1 | N/A: 0")]), (2, 1, [(1, a, "Y: 0 | N: 0 | N/A: 1")])]
    assert reports.report_figures(spark.createDataFrame([], "report int, standard int, spec int, reader string, compliance string")).count() == 0
