"""Streams, drained, and rules on event order as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest as L
from ..registry import query
from ..sources import views as V
from ..streaming import engine as E
from ..streaming import rules as R
from ..streaming import stateful as ST


@query(
    "error_fingerprints", "SM1 SM2",
    f"WITH {V.ERROR_SQL} SELECT md5(category || ':' || severity || ':' || substr(message, 1, 100)) AS key, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM error GROUP BY 1",
)
def _(t):
    stream = E.as_stream(V.errors(t).withColumn("ts", F.col("ts").cast("timestamp")))
    counts = E.running_counts(stream, R.fingerprint(F.col("category"), F.col("severity"), F.col("message")), "ts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return E.last_update(E.drained(counts, "update"), "key").select("key", "occurrences", shown("first_at"), shown("last_at"))


@query("error_fingerprints_batch", "SM1 SM2", f"WITH {V.ERROR_SQL} SELECT fingerprint, count(*) AS occurrences, min(id) AS first_id, max(id) AS last_id FROM error GROUP BY 1")
def _(t):
    return V.errors(t).groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def chunks(t):
    """conv_id, turn, total: a conversation's turns as the chunks of a document."""
    turns = t.conversations.select("conv_id", "turn")
    return turns.join(turns.groupBy("conv_id").agg(F.count_distinct("turn").alias("total")), "conv_id")


@query("chunks_assembled", "SM3", "SELECT conv_id, count(DISTINCT turn) AS received, true AS complete FROM conversations GROUP BY 1")
def _(t):
    return E.last_update(E.drained(ST.assembled_chunks(E.as_stream(chunks(t)), "conv_id", "turn", "total"), "update"), "conv_id")


@query("chunks_complete", "SM4", "SELECT conv_id, count(DISTINCT turn) AS received, count(DISTINCT turn) AS total, true AS complete FROM conversations GROUP BY 1")
def _(t):
    return R.chunks_complete(chunks(t), "conv_id", "turn", "total")


def arrivals(t):
    """A conversation's turns as chunks in an order of arrival that their digest deals out, so that firsts come late and lasts
    early. By hex digits of the digest: one in four comes twice, one in eight of another job, one in sixteen is an error."""
    turns = t.conversations.select("conv_id", "turn", F.col("text").isNotNull().alias("has_section"), F.md5(F.concat_ws("/", "conv_id", "turn").cast("binary")).alias("d"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    digit = lambda i: F.substring("d", i, 1)
    number = lambda i: F.conv(F.substring("d", i, 8), 16, 10).cast("long")
    made = turns.join(last, "conv_id").select(
        "conv_id", "turn", "has_section", (F.col("last") + 1).alias("total"), (F.col("turn") < F.col("last")).alias("more"), F.when(digit(18) < "2", "b").otherwise("a").alias("job"),
        (digit(19) == "0").alias("failed"), F.explode(F.when(digit(17) < "4", F.array(number(1), number(9))).otherwise(F.array(number(1)))).alias("at"),
    )
    return made


@query(
    "chunks_in_order_of_arrival", "SM3 SM4",
    """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
d AS (SELECT c.conv_id, turn, text IS NOT NULL AS has_section, turn < last AS more, last + 1 AS total, md5(c.conv_id || '/' || turn) AS d FROM conversations c JOIN l ON l.conv_id = c.conv_id),
a AS (SELECT *, CASE WHEN d[18] < '2' THEN 'b' ELSE 'a' END AS job, d[19] = '0' AS failed, unnest(CASE WHEN d[17] < '4' THEN [('0x' || d[1:8])::BIGINT, ('0x' || d[9:16])::BIGINT] ELSE [('0x' || d[1:8])::BIGINT] END) AS moment FROM d),
r AS (SELECT *, turn = 0 OR job IS DISTINCT FROM lag(job) OVER (PARTITION BY conv_id ORDER BY moment, turn) AS begins FROM a WHERE NOT failed),
g AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY moment, turn ROWS UNBOUNDED PRECEDING) AS g FROM r),
ended AS (SELECT conv_id, arg_max(job, (moment, turn)) AS job, max(g) AS g FROM g GROUP BY 1),
counted AS (SELECT g.conv_id, any_value(g.job) AS job, max(g.total) AS total, count(*) FILTER (has_section) AS received, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY moment, turn) FILTER (has_section) AS sections FROM g JOIN ended e ON g.conv_id = e.conv_id AND g.g = e.g GROUP BY 1),
state AS (SELECT conv_id, coalesce(arg_max(CASE WHEN failed THEN 'failed' ELSE 'completed' END, (moment, turn)) FILTER (failed OR NOT more), 'processing') AS status FROM a GROUP BY 1)
SELECT s.conv_id, job, coalesce(received, 0) AS received, status, CASE WHEN status = 'completed' THEN coalesce(sections, '') ELSE '' END AS sections FROM state s LEFT JOIN counted c ON c.conv_id = s.conv_id""",
)
def _(t):
    c = F.col
    stream = E.as_stream_in_order(arrivals(t), "at")
    state = ST.chunks_in_order(stream, c("conv_id"), c("at"), c("turn"), c("job"), c("turn"), c("total"), c("more"), c("has_section"), c("failed"))
    last = E.last_update(E.drained(state, "update"), "key")
    return last.select(c("key").cast("long").alias("conv_id"), "job", "received", "status", "sections")


SESSION_SQL = """marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM marked),
sessions AS (SELECT user_id, run, min(ts) AS s, max(ts) AS l, count(*) AS n FROM runs GROUP BY 1, 2)"""


@query(
    "closed_sessions", "SM6",
    f"WITH {SESSION_SQL} SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(l, '%Y-%m-%d %H:%M:%S') AS last, n FROM sessions WHERE l + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def _(t):
    """The input comes in order of time, in several batches, so the watermark moves and nothing is late."""
    events = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = E.as_stream_in_order(events, "ts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return E.drained(E.closed_sessions(stream, "user_id", "ts", "30 minutes", "1 hour")).select("user_id", shown("start"), shown("last"), "n")


@query("sessions", "SM6", f"WITH {SESSION_SQL} SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(l, '%Y-%m-%d %H:%M:%S') AS last, n FROM sessions")
def _(t):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return R.sessions(t.events, "user_id", "ts", "30 minutes").select("user_id", shown("start"), shown("last"), "n")


def fingerprints(t, stretch: int = 1):
    """event_time, key, at, id, resolves: errors by the fingerprint of their message, resolved by purchases. Times run so many
    times as fast from the start of 2024."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) * stretch - (stretch - 1) * START
    rows = t.events.select(F.md5(F.substring(F.coalesce("props", F.lit("")), 1, 100).cast("binary")).alias("key"), at.alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("resolves"))
    return rows.withColumn("event_time", F.timestamp_micros("at"))


#: Microseconds: the start of 2024, a minute, a day.
START, MINUTE, DAY = 1_704_067_200_000_000, 60_000_000, 86_400_000_000
EPISODE_SQL = """e AS (SELECT md5(substr(coalesce(props, ''), 1, 100)) AS key, epoch_us(ts) * {s} - ({s} - 1) * {start} AS moment, event_id, event_type = 'purchase' AS r FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
episode AS (SELECT key, min(moment) FILTER (NOT r) AS first_at, count(*) FILTER (NOT r) AS occurrences, max(moment) FILTER (NOT r) AS last_at, max(moment) FILTER (r) AS resolved_at FROM g GROUP BY key, g HAVING count(*) FILTER (NOT r) > 0)"""


@query("error_episodes", "SM1", f"WITH {EPISODE_SQL.format(s=1, start=START)} SELECT * FROM episode")
def _(t):
    """Occurrences count until the error is resolved, and from one again after that."""
    c = F.col
    episodes = ST.error_episodes(E.as_stream_in_order(fingerprints(t), "at"), c("key"), c("at"), c("id"), c("resolves"))
    return E.last_update(E.drained(episodes, "update"), "key", "first_at", "first_id").drop("first_id", "expired_at")


@query(
    "resolved_errors_expired", "SM7",
    f"""WITH {EPISODE_SQL.format(s=12, start=START)}, mark AS (SELECT max(moment) // 1000 - {DAY // 1000} AS w FROM e)
SELECT key, first_at, occurrences, last_at, resolved_at, CASE WHEN (resolved_at + {90 * DAY}) // 1000 < w THEN resolved_at + {90 * DAY} END AS expired_at FROM episode, mark""",
)
def _(t):
    """90 days after it was resolved an error is forgotten; the events' month is stretched to a year."""
    c = F.col
    stream = E.as_stream_in_order(fingerprints(t, 12), "at").withWatermark("event_time", "1 day")
    episodes = ST.error_episodes(stream, c("key"), c("at"), c("id"), c("resolves"), 90 * DAY)
    return E.last_update(E.drained(episodes, "update"), "key", "first_at", "first_id").drop("first_id")


@query(
    "payloads_swept", "SM8",
    f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) AS moment FROM events), mark AS (SELECT max(moment) // 1000 - {60 * MINUTE // 1000} AS w FROM e),
v AS (SELECT key, moment, ((moment + {60 * MINUTE}) // {15 * MINUTE} + 1) * {15 * MINUTE} AS sweep, lead(moment) OVER (PARTITION BY key ORDER BY moment) AS after FROM e),
x AS (SELECT moment, sweep, CASE WHEN after < sweep THEN after WHEN after >= sweep OR sweep // 1000 < w THEN sweep END AS ended, after IS NULL OR after >= sweep AS unreplaced FROM v, mark),
s AS (SELECT unnest(generate_series(((moment + {15 * MINUTE - 1}) // {15 * MINUTE}) * {15 * MINUTE}, sweep, {15 * MINUTE})) AS at_sweep, ended, sweep FROM x)
SELECT at_sweep, count(*) FILTER (at_sweep < coalesce(ended, sweep)) AS alive, count(*) FILTER (at_sweep = ended AND ended = sweep) AS removed FROM s GROUP BY 1 HAVING alive + removed > 0""",
)
def _(t):
    """Payloads by user live an hour and until the next sweep, each quarter of an hour; for each sweep those that it
    finds alive and those that it removes."""
    c, grid = F.col, 15 * MINUTE
    rows = t.events.select(c("user_id").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("at"), c("event_id").alias("id"), c("ts").cast("timestamp").alias("event_time"))
    stream = E.as_stream_in_order(rows, "at").withWatermark("event_time", "1 hour")
    ended = E.last_update(E.drained(ST.swept_payloads(stream, c("key"), c("at"), c("id"), 60 * MINUTE, grid), "update"), "key", "stored_at")
    ended = ended.withColumn("sweep", (F.floor((c("stored_at") + 60 * MINUTE) / grid) + 1) * grid)
    each = ended.withColumn("at_sweep", F.explode(F.sequence(F.ceil(c("stored_at") / grid) * grid, c("sweep"), F.lit(grid))))
    alive, removed = c("at_sweep") < F.coalesce("ended_at", "sweep"), c("swept") & (c("at_sweep") == c("ended_at"))
    return each.groupBy("at_sweep").agg(F.count_if(alive).alias("alive"), F.count_if(removed).alias("removed")).where("alive + removed > 0")


@query(
    "callbacks_matched", "SM11",
    f"""WITH {V.VALIDATION_SQL}, p AS (SELECT * FROM validation WHERE status = 'pending'), latest AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY submission, standard, spec ORDER BY ts DESC, id DESC) = 1),
c AS (SELECT id AS callback, id - 1 AS execution, submission, standard, spec, status FROM validation WHERE status <> 'pending')
SELECT callback, coalesce(a.id, b.id) AS validation, CASE WHEN c.status = 'pass' THEN 'pass' ELSE 'fail' END AS result FROM c LEFT JOIN p a ON a.id = c.execution
LEFT JOIN latest b ON b.submission = c.submission AND b.standard = c.standard AND b.spec = c.spec""",
)
def _(t):
    """A callback belongs to the pending validation of its execution id, else to the section's latest pending one."""
    v, keys = V.validations(t), ["submission", "standard", "spec"]
    pending = v.where("status = 'pending'")
    latest = L.latest(pending, keys, F.desc("ts"), F.desc("id")).select(*keys, F.col("id").alias("by_section"))
    calls = v.where("status <> 'pending'").withColumnRenamed("id", "callback").withColumn("execution", F.col("callback") - 1)
    found = calls.join(pending.select(F.col("id").alias("execution"), F.col("id").alias("by_id")), "execution", "left").join(latest, keys, "left")
    return found.select("callback", F.coalesce("by_id", "by_section").alias("validation"), F.when(F.col("status") == "pass", "pass").otherwise("fail").alias("result"))
