from __future__ import annotations

import time

from pyspark.sql import functions as F

from quorumspark.streaming import engine as E
from quorumspark.streaming import rules as R
from quorumspark.streaming import stateful as S


c = F.col


def test_chunks_in_any_order_and_repeated(spark):
    rows = [(1, i, 3) for i in (2, 0, 1, 1)] + [(2, 0, 2), (2, 0, 2), (2, None, 2), (None, 0, 1), (3, None, None)]
    df = spark.createDataFrame(rows, "doc long, i long, n long")
    got = E.last_update(E.drained(S.assembled_chunks(E.as_stream(df, 3), "doc", "i", "n"), "update"), "doc")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 3, True), (2, 1, False), (3, 0, True), (None, 1, True)]
    batch = R.chunks_complete(df.where("doc < 3"), "doc", "i", "n").select("doc", "received", "complete")
    assert sorted(map(tuple, batch.collect())) == [(1, 3, True), (2, 1, False)]


def test_chunks_in_order_of_arrival(spark):
    rows = [
        # doc, arrival, job, index, total, more, section, failed
        (1, 1, "a", 0, 3, True, True, False), (1, 2, "a", 1, 3, True, True, False), (1, 3, "a", 0, 3, True, True, False), (1, 4, "a", 2, 3, False, True, False), (1, 5, "a", 2, 3, True, True, None),
        (2, 1, "a", 0, 2, True, True, False), (2, 2, "b", 1, 2, False, True, False),  # another job wipes
        (3, 1, "a", 0, 2, True, True, False), (3, 2, "a", 1, 2, True, False, True),  # failed
        (4, 1, "a", None, 2, True, True, False), (4, 2, "a", None, 2, None, None, False),  # no index, no more, no section
        (5, 1, None, 1, 2, True, True, False), (5, 2, None, 2, 2, True, True, False),  # a null job is always new
        (None, None, "a", 0, 1, False, True, False),
    ]
    df = spark.createDataFrame(rows, "doc long, at long, job string, i long, n long, more boolean, section boolean, failed boolean")
    for batches in (1, 3):  # the same whether the rows come in one trigger or in several
        stream = E.as_stream_in_order(df, "at", batches)
        state = S.chunks_in_order(stream, c("doc"), c("at"), c("i"), c("job"), c("i"), c("n"), c("more"), c("section"), c("failed"))
        got = E.last_update(E.drained(state, "update"), "key").select("key", "job", "received", "status", "sections")
        assert sorted(map(tuple, got.collect()), key=repr) == [
            ("1", "a", 3, "completed", "0,2,2"), ("2", "b", 1, "completed", "1"), ("3", "a", 1, "failed", ""), ("4", "a", 1, "completed", "-"), ("5", None, 1, "processing", ""), (None, "a", 1, "completed", "0"),
        ]


def events(spark, rows, batches):
    df = spark.createDataFrame(rows, "key string, at long, id long, resolves boolean").withColumn("event_time", F.timestamp_micros("at"))
    return E.as_stream_in_order(df, "at", batches)


def test_episodes_end_and_expire(spark):
    s = 1_000_000
    rows = [("x", 1 * s, 1, False), ("x", 2 * s, 2, None), ("x", 2 * s, 3, True), ("x", 3 * s, 4, True), ("x", 4 * s, 5, False), ("y", 5 * s, 6, True), ("y", 6 * s, 7, False), (None, 7 * s, 8, False), ("z", 60 * s, 9, False)]
    stream = events(spark, rows, 4).withWatermark("event_time", "10 seconds")
    got = E.last_update(E.drained(S.error_episodes(stream, c("key"), c("at"), c("id"), c("resolves"), 20 * s), "update"), "key", "first_at")
    # the first is resolved by row 3 and expires 20 s later; row 4 resolves nothing
    assert sorted((r["key"], r["first_at"] // s, r["occurrences"], r["last_at"] // s, r["resolved_at"], r["expired_at"]) for r in got.where("key is not null").collect()) == [
        ("x", 1, 2, 2, 2 * s, 22 * s), ("x", 4, 1, 4, None, None), ("y", 6, 1, 6, None, None), ("z", 60, 1, 60, None, None),
    ]
    assert got.where("key is null").count() == 1


def test_rows_behind_the_watermark_are_not_counted(spark, tmp_path):
    s = 1_000_000
    df = spark.createDataFrame([("x", t * s, t, False) for t in (100, 200, 5)], "key string, at long, id long, resolves boolean").withColumn("event_time", F.timestamp_micros("at"))
    for t in (100, 200, 5):  # a file each, the late one last
        df.where(F.col("id") == t).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).withWatermark("event_time", "10 seconds")
    got = E.last_update(E.drained(S.error_episodes(stream, c("key"), c("at"), c("id"), c("resolves"), 3600 * s), "update"), "key", "first_at").collect()
    assert [(r["first_at"] // s, r["occurrences"]) for r in got] == [(100, 2)]


def test_payloads_live_until_the_sweep_after_their_hour(spark):
    m, start = 60_000_000, 1500 * 60_000_000
    rows = [("a", 0, 1, False), ("b", 1 * m, 2, False), ("b", 30 * m, 3, False), ("c", 2 * m, 4, False), ("c", 74 * m, 5, False), ("d", 15 * m, 6, False), ("z", 1000 * m, 7, False)]
    stream = events(spark, [(k, start + at, i, r) for k, at, i, r in rows], 3).withWatermark("event_time", "1 minute")
    got = E.last_update(E.drained(S.swept_payloads(stream, c("key"), c("at"), c("id"), 60 * m, 15 * m), "update"), "key", "stored_at")
    assert sorted((r["key"], (r["stored_at"] - start) // m, r["ended_at"] and (r["ended_at"] - start) // m, r["swept"]) for r in got.collect()) == [
        # an hour old exactly is not yet over: the sweep of 75 takes a (0 + 60 < 75) and that of 90 takes d (15 + 60 = 75)
        ("a", 0, 75, True), ("b", 1, 30, False), ("b", 30, 105, True), ("c", 2, 74, False), ("c", 74, 135, True), ("d", 15, 90, True), ("z", 1000, None, False),
    ]


def test_empty_streams(spark):
    rows = spark.createDataFrame([], "key string, at long, id long, resolves boolean")
    stream = E.as_stream_in_order(rows, "at")
    assert E.drained(S.error_episodes(stream, c("key"), c("at"), c("id"), c("resolves")), "update").count() == 0


def test_debounce_keeps_the_last_of_a_burst(spark):
    rows = [("a", f"2024-01-01 00:00:0{s}", s) for s in (0, 1, 5)] + [("b", "2024-01-01 00:00:00", 9)]
    df = spark.createDataFrame(rows, "k string, t string, id int").selectExpr("k", "cast(t as timestamp) t", "id")
    assert sorted(r["id"] for r in R.debounced(df, "k", "t", "id", "2 seconds").collect()) == [1, 5, 9]
