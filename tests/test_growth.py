"""What must not grow faster than the input: calls and entries by row, and time limits of our own."""

from __future__ import annotations

import inspect
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

import quorumspark.plans  # noqa: F401
from quorumspark.operators import machines as M
from quorumspark.operators import payload as P
from quorumspark.operators import writes as W
from quorumspark.registry import REGISTRY
from quorumspark.streaming import engine as E
from quorumspark.streaming import outbox as O
from quorumspark.streaming import stateful as S

c = F.col


# --- episodes


class Handle:
    """The state of one key, which counts the entries that it hands out."""

    def __init__(self):
        self.value, self.map, self.timers, self.entries = None, {}, set(), 0
        self.getValueState = lambda *_: SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))
        self.getMapState = lambda *_: SimpleNamespace(getValue=self.read, updateValue=self.map.__setitem__, removeKey=self.map.pop, iterator=lambda: map(self.item, list(self.map.items())))
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def item(self, x):
        self.entries += 1
        return x

    def read(self, k):
        self.entries += 1
        return self.map.get(k)


def test_expiry_reads_an_episode_a_few_times_at_most():
    n, day = 500, 86_400_000_000
    p, handle = S.Episodes(90 * day), Handle()
    p.init(handle)
    row = Row("key", "at", "id", "resolves")
    told = list(p.handleInputRows(("x",), iter([row("x", i * day // 2, i, i % 2 == 1) for i in range(2 * n)]), None))
    assert len(told) == n and handle.timers
    expired, mark = [], (n + 91) * day // 1000
    for mark in (mark // 2, mark):  # the watermark once midway
        for due in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(due)
            expired += p.handleExpiredTimer(("x",), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), SimpleNamespace(getExpiryTimeInMs=lambda due=due: due))
    assert sorted(r["first_at"] for r in expired) == [i * day for i in range(n)] and not handle.map and not handle.timers
    assert handle.entries <= 4 * n


def test_episodes_that_began_at_one_time_are_all_told(spark):
    rows = [("x", 5, 1, False), ("x", 5, 2, True), ("x", 5, 3, False), ("x", 5, 4, True), ("z", 10**9, 5, False)]
    df = spark.createDataFrame(rows, "key string, at long, id long, resolves boolean").withColumn("event_time", F.timestamp_micros("at"))
    stream = E.as_stream_in_order(df, "at", 2).withWatermark("event_time", "1 second")
    got = E.last_update(E.drained(S.error_episodes(stream, c("key"), c("at"), c("id"), c("resolves"), 10**6), "update"), "key", "first_at", "first_id")
    assert sorted((r["key"], r["first_id"], r["occurrences"], r["expired_at"]) for r in got.collect()) == [("x", 1, 1, 10**6 + 5), ("x", 3, 1, 10**6 + 5), ("z", 5, 1, None)]


def test_streams_run_as_long_as_their_input_takes():
    assert inspect.signature(E.drained).parameters["timeout_s"].default is None


def test_a_payload_asks_its_state_once_and_keeps_its_timer():
    calls = []
    value = SimpleNamespace(exists=lambda: calls.append("exists") or True, get=lambda: calls.append("get") or (0,), update=lambda v: calls.append("update"))
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda _: calls.append("register"), deleteTimer=lambda _: calls.append("delete"))
    p = S.Payloads(60, 15)
    p.init(handle)
    row = Row("key", "at", "id")
    told = [(r["stored_at"], r["ended_at"], r["swept"]) for r in p.handleInputRows(("x",), iter([row("x", 7, 1)]), None)]
    assert told == [(0, 7, False), (7, None, False)] and calls == ["get", "update"]


# --- status machines


def test_machine_groups_no_rows_by_key(spark):
    """Keys that end and begin within a task, at its edges, and without a row between; NaN is one key."""
    rows = [(float("nan") if k == 9 else float(k), i, "start" if i % 3 else "fail") for k in range(10) for i in range(k + 1)]
    df = spark.createDataFrame(rows, "k double, i int, event string").repartition(3)
    told = M.run_machine(df, "k", ["i"], c("event"), M.IMPORT, "pending", 4)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning" not in plan
    got = {(str(r["k"]), r["i"]): (r["before"], r["after"]) for r in told.collect()}
    assert len(got) == len(rows)
    for k in {str(r[0]) for r in rows}:
        state = "pending"
        for _, i, e in sorted((r for r in rows if str(r[0]) == k), key=lambda r: r[1]):
            after = M.IMPORT.get((state, e), state)
            assert got[k, i] == (state, after)
            state = after


# --- job feeds


def test_a_feed_is_parsed_once_and_read_by_types(spark):
    bodies = [
        '{"data":{"teamName":0,"teamId":"0","job":{"title":"false","description":false,"duration":0.00,"engagement":"-0","city":1,"ciphertext":"0x","client":{"paymentVerified":"false","location":[1],"stats":{"totalSpent":"-0.5","hireRate":-0.0,"totalHires":"0"}}}}}',
        '{"data":"text"}', '{"data":{"job":[1]}}', '{"data":{"job":0}}', '{"data":0}', '{"data":{"job":{"title":{"a":0},"ciphertext":"null","client":"x","skills":[{"name":0},{"name":"0"},7]}}}', "", None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    made = P.feed_jobs(df, "body", "u/")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    got = [(r["job"], r["error"]) for r in made.orderBy("i").collect()]
    first = got[0][0]
    assert (first["title"], first["description"], first["duration"], first["engagement"], first["ciphertext"], first["url"]) == ("false", "", "", "-0", "0x", "u/0x")
    assert (first["team_name"], first["team_id"], first["payment_verified"], first["country"]) == ("", "0", True, "")
    assert (first["total_spent"], first["hire_rate"], first["total_hires"]) == (-0.5, None, 0.0)
    assert (got[5][0]["title"], got[5][0]["ciphertext"], got[5][0]["payment_verified"], got[5][0]["skills"]) == ('{"a":0}', "null", False, '["{\\"name\\":0}","0","7"]')
    assert [(j is not None, e) for j, e in got] == [
        (True, None), (False, "job is missing"), (True, "ciphertext is missing"), (False, "job is missing"), (False, "data is missing"), (True, None), (False, "data is missing"), (False, "data is missing"),
    ]


# --- deliveries


def test_log_entries_are_handed_over_by_batches_of_requests():
    run = O.answered(SimpleNamespace(mapInArrow=lambda f, _: f), lambda *_: (200, "{}"))
    rows = [{"id": str(i), "url": "u", "headers": [], "body": "", "timeout_ms": 1, "attempt": 1} for i in range(100)]
    made = list(run(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [b.num_rows for b in made] == [100] and made[0].column("id").to_pylist() == [r["id"] for r in rows]


# --- matrix cells


def test_cells_and_changes_meet_in_tasks_of_a_bounded_number_of_lines(spark, data, monkeypatch):
    from quorumspark.plans import relating
    from tests.oracle import rows_of_spark, rows_of_sql

    q = REGISTRY["matrix_import"]
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(relating, "CELLS", lines // 20, raising=False)
    got = q.run(spark, data)
    assert got.rdd.getNumPartitions() >= 20
    assert rows_of_spark(got) == rows_of_sql(q.sql, data)


def test_a_last_change_to_nothing_empties_its_cell(spark):
    flat = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "s string, p int, v int")
    changes = spark.createDataFrame([("a", 1, 8, 1), ("a", 1, None, 2), ("a", 2, None, 1), ("a", 2, 9, 2)], "s string, p int, v int, at int")
    got = W.nested_upsert(flat, changes, ["s", "p"], "v", "at", parts=7)
    assert sorted(map(tuple, got.select("s", "p", "v").collect())) == [("a", 2, 9), ("b", 1, 7)]
