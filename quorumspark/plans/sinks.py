"""Sinks, deliveries, status machines and redaction as queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import exports as X
from ..operators import machines as M
from ..operators import redaction as R
from ..operators import reports
from ..operators import snapshots
from ..operators import usage as U
from ..registry import query
from ..sources import views as V
from ..sources.shared import fresh_path
from ..streaming import engine as E
from ..streaming import outbox as O
from .aggregating import COUNTS_SQL, CELLS_SQL, cells
from .recording import OLD_NEW_SQL, old_new


@query("replace_all", "SK2", f"WITH {OLD_NEW_SQL} SELECT *, 2::BIGINT AS version FROM new UNION ALL SELECT *, 1 FROM old")
def _(t):
    """Both versions: the one that readers find, and the one that those who began before it still read."""
    old, new = old_new(t)
    path = fresh_path(t.spark, "replaced")
    snapshots.replace(old, path)
    began = snapshots.current(t.spark, path, old.schema)
    snapshots.replace(new, path)
    number = lambda n: F.lit(n).cast("long").alias("version")
    return snapshots.current(t.spark, path, old.schema).select("*", number(2)).unionByName(began.select("*", number(1)))


@query(
    "compilation_csv", "SK9 AG13",
    f"""WITH {COUNTS_SQL}, votes AS (SELECT standard, spec, string_agg(CASE n WHEN 1 THEN 'compliant' WHEN 2 THEN 'non_compliant' ELSE 'not_applicable' END || ': ' || k, '; ' ORDER BY n) FILTER (k > 0) AS v
  FROM (SELECT standard, spec, unnest([1, 2, 3]) AS n, unnest([n_compliant, n_non_compliant, n_not_applicable]) AS k FROM agreed) GROUP BY 1, 2),
l AS (SELECT a.standard, a.spec, concat_ws(',', a.standard, a.spec, coalesce(consensus, ''), CASE WHEN a.spec % 50 = 0 THEN 'compliant' ELSE '' END, CASE WHEN disagreement THEN 'Yes' ELSE 'No' END, '"' || coalesce(v, '') || '"') AS line
  FROM agreed a LEFT JOIN votes v ON v.standard = a.standard AND v.spec = a.spec)
SELECT row_number() OVER (ORDER BY standard, spec) AS n, line FROM l UNION ALL SELECT 0, 'Standard,Specification,Consensus,Final Determination,Has Disagreement,Reader Votes'""",
)
def _(t):
    """Written as files in order below one header, and read back; votes are quoted, nothing is escaped."""
    c = F.col
    said = F.array_join(F.array_compact(F.array(*(F.when(c(f"n_{v}") > 0, F.concat(F.lit(f"{v}: "), c(f"n_{v}").cast("string"))) for v in C.VOTES))), "; ")
    final = F.when(c("spec") % 50 == 0, "compliant")
    line = X.plain(c("standard"), c("spec"), c("consensus"), final, F.when(c("disagreement"), "Yes").otherwise("No"), X.quoted(said))
    path = fresh_path(t.spark, "compilation-csv")
    X.write_lines(C.consensus(V.votes(t), ["standard", "spec"]), [c("standard"), c("spec")], line, "Standard,Specification,Consensus,Final Determination,Has Disagreement,Reader Votes", path)
    return X.read_lines(t.spark, path)


@query(
    "matrix_csv", "SK10 AG14",
    f"""WITH {CELLS_SQL}, w AS (SELECT standard, spec, {", ".join(f"coalesce(max(CASE WHEN course = {i} THEN kind || '/' || depth END), '') AS c{i}" for i in range(5))} FROM cell GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY standard, spec) AS n, concat_ws(',', standard, spec, {", ".join(f"c{i}" for i in range(5))}) AS line FROM w UNION ALL SELECT 0, 'Standard,Specification,{",".join(f"C {i}" for i in range(5))}'""",
)
def _(t):
    value = F.when(F.col("kind").isNotNull() & F.col("depth").isNotNull(), F.concat_ws("/", "kind", "depth"))
    wide = cells(t).withColumn("v", value).groupBy("standard", "spec").pivot("course", [0, 1, 2, 3, 4]).agg(F.first("v", ignorenulls=True))
    path = fresh_path(t.spark, "matrix-csv")
    X.write_lines(wide, [F.col("standard"), F.col("spec")], X.plain(*(F.col(f"`{c}`") for c in wide.columns)), "Standard,Specification," + ",".join(f"C {i}" for i in range(5)), path)
    return X.read_lines(t.spark, path)


@query(
    "parts_csv", "SK10",
    """SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey || ',' || CASE WHEN p_partkey % 3 = 0 THEN chr(34) || p_name || ', ' || chr(34) || chr(34) || p_brand || chr(34) || chr(34) || chr(34) ELSE p_name END AS line FROM part
UNION ALL SELECT 0, 'Key,Name'""",
)
def _(t):
    """The escaped form: names with commas and quotes in them."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    path = fresh_path(t.spark, "parts-csv")
    X.write_lines(t.part, [F.col("p_partkey")], X.escaped(F.col("p_partkey"), name), "Key,Name", path)
    return X.read_lines(t.spark, path)


def loopback(url: str, headers: dict[str, str], body: str, timeout_s: float) -> tuple[int, str]:
    """A receiver within the sender: down for each eleventh section, and not a JSON one for each thirteenth."""
    sent = json.loads(body)
    if sent["submission"] % 11 == 0:
        return 503, "down"
    return 200, "no JSON" if sent["submission"] % 13 == 0 else json.dumps({"executionId": headers["Idempotency-Key"]})


@query(
    "webhook_deliveries", "SK12",
    f"""WITH {V.VALIDATION_SQL} SELECT id::VARCHAR AS id, CASE WHEN submission % 11 = 0 OR submission % 13 = 0 THEN 2 ELSE 1 END AS attempts, submission % 11 <> 0 AND submission % 13 <> 0 AS success,
  CASE WHEN submission % 11 <> 0 AND submission % 13 <> 0 THEN id::VARCHAR END AS execution_id, CASE WHEN submission % 11 = 0 THEN 'the receiver returned 503' WHEN submission % 13 = 0 THEN 'Expecting value: line 1 column 1 (char 0)' END AS error FROM validation WHERE status = 'pending'""",
)
def _(t):
    """Pending validations go through the outbox as a stream, and once more as a batch, which sends nothing again."""
    c = F.col
    pending = V.validations(t).where("status = 'pending'")
    head = O.headers(c("id"), F.when(c("id") % 2 == 0, "api_key").otherwise("bearer"), F.lit("key"), F.lit("token"), F.lit(None).cast("map<string,string>"))
    requests = pending.select("id", F.lit("loopback").alias("url"), head.alias("headers"), F.to_json(F.struct("submission", "standard", "spec")).alias("body"), F.lit(None).cast("long").alias("timeout_ms"))
    log = fresh_path(t.spark, "outbox")
    started = O.deliver_stream(E.as_stream(requests, 2), log, fresh_path(t.spark, "stream-checkpoint"), loopback, attempts=2, availableNow=True)
    started.awaitTermination()
    O.deliver(requests, log, loopback, attempts=2)
    return O.outcomes(t.spark, log)


@query(
    "webhook_headers", "SK12",
    f"""WITH {V.VALIDATION_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'X-API-Key=key' WHEN id % 4 = 1 THEN 'Authorization=Bearer token' ELSE '' END AS auth, CASE WHEN id % 3 = 0 THEN 'text/plain' ELSE 'application/json' END AS kind, CASE WHEN id % 3 = 0 THEN 3 ELSE 2 END + CASE WHEN id % 4 < 2 THEN 1 ELSE 0 END AS n FROM validation""",
)
def _(t):
    """By key, by bearer token, by a key that is empty, and without; a third have headers of their own."""
    c = F.col
    kind, key = V.cases(c("id") % 4, {0: "api_key", 1: "bearer", 2: "api_key"}, "none"), F.when(c("id") % 4 == 0, "key").otherwise("")
    extra = F.when(c("id") % 3 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("X-Trace"), c("id").cast("string")))
    h = V.validations(t).select("id", O.headers(c("id"), kind, key, F.lit("token"), extra).alias("h"))
    auth = F.concat(*(F.coalesce(F.concat(F.lit(f"{n}="), F.try_element_at("h", F.lit(n))), F.lit("")) for n in ("X-API-Key", "Authorization")))
    return h.select("id", auth.alias("auth"), F.element_at("h", "Content-Type").alias("kind"), F.size("h").alias("n"))


@query(
    "counter_and_transition", "SK18",
    """WITH k AS (SELECT c_custkey AS key, c_acctbal >= 0 AS active, CASE WHEN c_nationkey > 4 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_nationkey) DAY END AS expires_at, CASE WHEN c_mktsegment <> 'BUILDING' THEN 20 END AS use_limit, c_custkey % 5 AS used FROM customer),
u AS (SELECT k.*, e.ts, k.active AND coalesce(e.ts <= k.expires_at, true) AS valid FROM k JOIN events e ON e.user_id = k.key),
r AS (SELECT *, row_number() OVER (PARTITION BY key, valid ORDER BY ts) AS i FROM u),
n AS (SELECT key, count(*) AS total, count(*) FILTER (valid AND (use_limit IS NULL OR i <= use_limit - used)) AS n, max(ts) FILTER (valid AND (use_limit IS NULL OR i <= use_limit - used)) AS last_at FROM r GROUP BY 1)
SELECT k.key, k.used + coalesce(n, 0) AS used, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_used_at, coalesce(total - n, 0) AS refused,
  CASE WHEN NOT active THEN 'inactive' WHEN k.used + coalesce(n, 0) >= use_limit THEN 'exhausted' WHEN expires_at < TIMESTAMP '2024-01-31' THEN 'expired' ELSE 'active' END AS state FROM k LEFT JOIN n ON n.key = k.key""",
)
def _(t):
    """Customers as keys, events as their uses."""
    c = F.col
    keys = t.customer.select(
        c("c_custkey").alias("key"), (c("c_acctbal") >= 0).alias("active"), F.when(c("c_nationkey") > 4, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(c("c_nationkey").cast("int"))).alias("expires_at"),
        F.when(c("c_mktsegment") != "BUILDING", 20).alias("use_limit"), (c("c_custkey") % 5).alias("used"), F.lit(None).cast("timestamp").alias("last_used_at"),
    )
    uses = t.events.select(c("user_id").alias("key"), c("ts").cast("timestamp").alias("ts"))
    done = U.used_keys(keys, uses, "key", "ts", F.lit("2024-01-31").cast("timestamp"))
    return done.select("key", "used", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss").alias("last_used_at"), "refused", "state")


IMPORT_EVENTS = {"signup": "start", "view": "complete", "error": "fail", "purchase": "cancel"}


@query(
    "import_state_machine", "SM13",
    """WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'cancel' END AS event FROM events),
m(state, event, next) AS (VALUES ('pending', 'start', 'processing'), ('processing', 'complete', 'completed'), ('processing', 'fail', 'failed'), ('pending', 'fail', 'failed'), ('pending', 'cancel', 'cancelled'), ('processing', 'cancel', 'cancelled'), ('failed', 'start', 'processing')),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, 'pending' AS after, true AS legal FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.i, e.event_id, r.after, coalesce(m.next, r.after), m.next IS NOT NULL FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1 LEFT JOIN m ON m.state = r.after AND m.event = e.event)
SELECT event_id, before, after, legal FROM r WHERE event_id IS NOT NULL""",
)
def _(t):
    """Each user's events as an import's; clicks are no event of it and illegal, as are moves after its end."""
    rows = t.events.select("event_id", "user_id", "ts", V.cases(F.col("event_type"), IMPORT_EVENTS).alias("event"))
    told = M.run_machine(rows, "user_id", ["ts", "event_id"], F.col("event"), M.IMPORT, "pending")
    return told.select("event_id", "before", "after", "legal")


@query(
    "load_state_machine", "SM13",
    """WITH e AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'trigger' WHEN '2-HIGH' THEN 'failed' WHEN '5-LOW' THEN 'error' WHEN '3-MEDIUM' THEN 'success' ELSE o_orderpriority END AS status FROM orders)
SELECT o_custkey, arg_max(CASE WHEN status = 'trigger' THEN 'loading' WHEN status IN ('failed', 'error') THEN 'error' ELSE 'loaded' END, (o_orderdate, o_orderkey)) AS state, count(*) FILTER (status IN ('failed', 'error')) AS errors, count(*) AS reports FROM e GROUP BY 1""",
)
def _(t):
    """Each customer's orders as reports of a load: an unknown status counts as loaded."""
    c = F.col
    status = V.cases(c("o_orderpriority"), {"1-URGENT": "trigger", "2-HIGH": "failed", "5-LOW": "error", "3-MEDIUM": "success"}, c("o_orderpriority"))
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", M.load_event(status).alias("event"))
    told = M.run_machine(rows, "o_custkey", ["o_orderdate", "o_orderkey"], c("event"), M.LOAD, "not_loaded")
    last = F.max_by("after", F.struct("o_orderdate", "o_orderkey")).alias("state")
    return told.groupBy("o_custkey").agg(last, F.count_if(c("after") == "error").alias("errors"), F.count("*").alias("reports"))


@query(
    "messages_redacted", "PR7",
    """SELECT event_id, '{"id":' || event_id || ',"user":{"name":"u' || user_id || '","Password":"[REDACTED]","tokens":"[REDACTED]","parts":[{"secretNote":"[REDACTED]"},{"ok":true,"sums":[' || event_id || ',[]]}]},"props":' || replace(props, ' ', '') || ',"authorization":"[REDACTED]","note":"token: {x}"}' AS message FROM events""",
)
def _(t):
    """Names, lists and objects below lists; what only looks like a name, or stands in a text, stays."""
    s = lambda x: F.col(x).cast("string")
    parts = [
        '{"id": ', s("event_id"), ', "user": {"name": "u', s("user_id"), '", "Password": "p', s("event_id"), '", "tokens": [1, {"a": "', s("event_type"), '"}], "parts": [{"secretNote": {"x": [1, {"y": null}]}}, {"ok": true, "sums": [', s("event_id"),
        ', []]}]}, "props": ', s("props"), ', "authorization": null, "note": "token: {x}"}',
    ]
    message = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return R.redacted_documents(t.events.select("event_id", message.alias("message")), "message")


@query(
    "report_figures", "SK11 AG35",
    """WITH v AS (SELECT o_custkey AS report, l_partkey % 21 + 1 AS standard, l_linenumber AS spec, 'reader ' || l_suppkey % 3 AS reader,
  CASE WHEN l_quantity > 45 THEN NULL WHEN l_returnflag = 'A' THEN 'compliant' WHEN l_returnflag = 'R' THEN 'non_compliant' ELSE 'not_applicable' END AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT report, standard, spec, count(*) FILTER (c = 'compliant') AS y, count(*) FILTER (c = 'non_compliant') AS n, count(*) FILTER (c = 'not_applicable') AS a FROM v GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN greatest(y, n, a) = 0 THEN NULL WHEN y >= n AND y >= a THEN 'compliant' WHEN n >= a THEN 'non_compliant' ELSE 'not_applicable' END AS consensus, (y > 0)::INT + (n > 0)::INT + (a > 0)::INT > 1 AS differs, 'Y: ' || y || ' | N: ' || n || ' | N/A: ' || a AS votes FROM s),
b AS (SELECT report, standard, standard || ' [' || string_agg(spec || ': ' || coalesce(consensus, '-') || ', ' || votes, '; ' ORDER BY spec) || ']' AS part FROM k GROUP BY 1, 2),
r AS (SELECT report, reader, reader || ': ' || count(c) || ' of ' || count(*) || ', Y: ' || count(*) FILTER (c = 'compliant') || ' | N: ' || count(*) FILTER (c = 'non_compliant') || ' | N/A: ' || count(*) FILTER (c = 'not_applicable') AS part FROM v GROUP BY 1, 2),
t AS (SELECT report, count(*) AS total, count(*) FILTER (consensus = 'compliant') AS compliant, count(*) FILTER (consensus = 'non_compliant') AS non_compliant, count(*) FILTER (consensus = 'not_applicable') AS not_applicable, count(*) FILTER (differs) AS disagreements FROM k GROUP BY 1)
SELECT t.*, CAST(floor(compliant * 100 / nullif(total - not_applicable, 0) + 0.5) AS BIGINT) AS compliance_rate, compliant || ' (' || CAST(floor(compliant * 100 / total + 0.5) AS BIGINT) || '%)' AS compliant_share, non_compliant || ' (' || CAST(floor(non_compliant * 100 / total + 0.5) AS BIGINT) || '%)' AS non_compliant_share,
  (SELECT string_agg(part, ' ' ORDER BY standard) FROM b WHERE b.report = t.report) AS standards, (SELECT string_agg(part, '; ' ORDER BY reader) FROM r WHERE r.report = t.report) AS readers FROM t""",
)
def _(t):
    """A customer's orders as a report, their lines as votes of three readers."""
    c = F.col
    vote = V.cases(c("l_returnflag"), {"A": "compliant", "R": "non_compliant"}, "not_applicable")
    votes = t.lineitem.join(t.orders.select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("report")), "l_orderkey").select(
        "report", (c("l_partkey") % 21 + 1).alias("standard"), c("l_linenumber").alias("spec"), F.concat(F.lit("reader "), (c("l_suppkey") % 3).cast("string")).alias("reader"), F.when(c("l_quantity") <= 45, vote).alias("compliance")
    )
    text = lambda x: x.cast("string")
    line = lambda x: F.concat(text(x["spec"]), F.lit(": "), F.coalesce(x["consensus"], F.lit("-")), F.lit(", "), x["votes"])
    standard = lambda s: F.concat(text(s["standard"]), F.lit(" ["), F.array_join(F.transform(s["lines"], line), "; "), F.lit("]"))
    reader = lambda r: F.concat(r["reader"], F.lit(": "), text(r["given"]), F.lit(" of "), text(r["asked"]), F.lit(", "), r["summary"])
    made = reports.report_figures(votes)
    return made.select(
        "report", "total", *C.VOTES, "disagreements", "compliance_rate", c("shares.compliant").alias("compliant_share"), c("shares.non_compliant").alias("non_compliant_share"),
        F.array_join(F.transform("standards", standard), " ").alias("standards"), F.array_join(F.transform("readers", reader), "; ").alias("readers"),
    )
