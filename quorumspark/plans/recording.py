"""Sources, writes as frames, payloads, scalar functions and constraints as queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import payload as P
from ..operators import quality as Q
from ..operators import writes as W
from ..registry import query
from ..sources.shared import fresh_path
from ..sources import formats as SRC
from ..sources import views as V


@query("scan_all", "SC1", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return t.region


@query("find_by_id", "SC2", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def _(t):
    return t.customer.where("c_custkey = 77").limit(1).select("c_custkey", "c_name")


@query("find_first", "SC3", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query(
    "slide_texts", "SC6",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'Part ' || l_partkey || ' ' || l_linestatus || ' &amp; more' END AS text FROM lineitem",
)
def _(t):
    """Texts of slide XML, a slide for each line of an order: runs with and without attributes, and slides without text."""
    run = lambda tag, *xs: F.concat(F.lit(f"<a:r><a:rPr lang='en'/><a:t{tag}>"), *xs, F.lit("</a:t></a:r>"))
    runs = F.concat(run("", F.lit("Part "), F.col("l_partkey").cast("string")), run(" xml:space='preserve'", F.col("l_linestatus")), run("", F.lit("&amp; more")))
    xml = F.concat(F.lit("<p:sp><p:txBody>"), F.when(F.col("l_returnflag") == "R", "<a:p/>").otherwise(runs), F.lit("</p:txBody></p:sp>"))
    # each run is one text; the parts of the first are one run
    return t.lineitem.select("l_orderkey", "l_linenumber", SRC.slide_text(xml).alias("text"))


@query(
    "format_dispatch", "SC4 SC5 SC7",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'pptx' ELSE 'unsupported' END AS parser FROM pages",
)
def _(t):
    names = F.array(*map(F.lit, ["A.b.PDF", "x.docx", "y.pptx", "z.txt", "noextension"]))
    return t.pages.select("page_id", SRC.parser_of(F.get(names, (F.col("page_id") % 5).cast("int"))).alias("parser"))


@query("json_round_trip", "SC9", f"WITH {V.POST_SQL} SELECT id, status, len(tags) AS n_tags, title FROM post")
def _(t):
    posts = V.posts(t)
    text = posts.select(F.to_json(F.struct("id", "status", "tags", "content")).alias("j"))
    back = text.select(F.from_json("j", "id long, status string, tags array<string>, content map<string,string>").alias("p")).select("p.*")
    return back.select("id", "status", F.size("tags").cast("long").alias("n_tags"), F.array_max(F.map_values("content")).alias("title"))


@query(
    "legacy_migration", "SC10",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'ready' ELSE 'draft' END AS status, 1::BIGINT AS n_platforms, o_orderpriority AS body FROM orders""",
)
def _(t):
    old = t.orders.select(F.col("o_orderkey").alias("id"), V.cases(F.col("o_orderstatus"), {"F": "posted", "O": "ready"}, "whatever").alias("status"), F.lit("linkedin").alias("platform"), F.col("o_orderpriority").alias("text"))
    new = SRC.migrated(old)
    return new.select("id", "status", F.size("platforms").cast("long").alias("n_platforms"), F.col("content")[F.col("platforms")[0]].alias("body"))


OLD_NEW_SQL = "old AS (SELECT c_custkey, c_name, c_mktsegment FROM customer), new AS (SELECT c_custkey, '' AS c_name, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 5000000, 'Added', 'NEW')"


def old_new(t):
    old = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return old, new.unionByName(t.frame([(5000000, "Added", "NEW")], "c_custkey long, c_name string, c_mktsegment string"))


@query("append_rows", "SK1", f"WITH {OLD_NEW_SQL} SELECT * FROM old UNION ALL SELECT * FROM new")
def _(t):
    old, new = old_new(t)
    path = fresh_path(t.spark, "appended")
    W.append_to(old, path)
    W.append_to(new, path)
    return t.spark.read.schema(old.schema).parquet(path)


@query("upsert_rows", "SK3", f"WITH {OLD_NEW_SQL} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey")
def _(t):
    return W.upsert(*old_new(t), "c_custkey")


@query("upsert_filled_only", "SK3", f"WITH {OLD_NEW_SQL} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(nullif(n.c_name, ''), o.c_name) AS c_name, coalesce(nullif(n.c_mktsegment, ''), o.c_mktsegment) AS c_mktsegment FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey")
def _(t):
    return W.upsert(*old_new(t), "c_custkey", only_filled=True)


@query("bulk_update", "SK4", "SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'NATION_FOUR' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return W.update_where(t.customer, F.col("c_nationkey") == 4, c_mktsegment=F.lit("NATION_FOUR")).select("c_custkey", "c_mktsegment")


@query(
    "history_on_change", "SK5 SK17",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'created' ELSE 'created,moved to ' || strftime(o_orderdate + INTERVAL (o_orderkey % 4) DAY, '%Y-%m-%d') END AS history FROM orders",
)
def _(t):
    new = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int"))
    entry = F.concat(F.lit("moved to "), F.date_format(new, "yyyy-MM-dd"))
    history = W.append_on_change(F.array(F.lit("created")), F.to_date("o_orderdate"), new, entry)
    return t.orders.select("o_orderkey", F.array_join(history, ",").alias("history"))


@query("soft_delete", "SK6", f"WITH {V.EVIDENCE_SQL} SELECT kind, count(*) AS n FROM evidence WHERE id % 7 <> 0 GROUP BY 1")
def _(t):
    marked = W.update_where(V.evidence(t).withColumn("is_deleted", F.lit(False)), F.col("id") % 7 == 0, is_deleted=F.lit(True))
    return marked.where(~F.col("is_deleted")).groupBy("kind").agg(F.count("*").alias("n"))


@query("hard_delete", "SK7", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return W.delete_keys(t.orders, "o_custkey", t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey")


@query("clear_references", "SK8", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE o_custkey END AS folder FROM orders")
def _(t):
    gone = t.customer.where("c_custkey % 10 = 3")
    return W.clear_reference(t.orders.withColumnRenamed("o_custkey", "folder"), "folder", gone, "c_custkey").select("o_orderkey", "folder")


@query(
    "nested_upsert", "SK14",
    f"""WITH {V.VALIDATION_SQL}, o AS (SELECT submission, standard, spec, max(status) AS v FROM validation WHERE id % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT submission, standard, spec, arg_max(status, id) AS v FROM validation WHERE id % 2 = 1 GROUP BY 1, 2, 3)
SELECT coalesce(o.submission, n.submission) AS submission, string_agg(coalesce(o.spec, n.spec) || '=' || coalesce(n.v, o.v), ',' ORDER BY coalesce(o.spec, n.spec)) AS specs FROM o FULL JOIN n ON o.submission = n.submission AND o.standard = n.standard AND o.spec = n.spec GROUP BY 1""",
)
def _(t):
    v, keys = V.validations(t), ["submission", "standard", "spec"]
    old = v.where("id % 2 = 0").groupBy(*keys).agg(F.max("status").alias("v"))
    merged = W.nested_upsert(old, v.where("id % 2 = 1").withColumnRenamed("status", "v"), keys, "v", "id")
    return merged.groupBy("submission").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "spec", "v"))), ",").alias("specs"))


@query("nested_delete", "SK15", "SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_linenumber <> 3), '') AS lines FROM lineitem GROUP BY 1")
def _(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id")))).alias("items"))
    left = W.without_key(F.col("items"), "id", F.lit(3))
    return nested.select("l_orderkey", F.array_join(F.transform(left, lambda x: x["id"].cast("string")), ",").alias("lines"))


@query(
    "webhook_requests", "SK12",
    f"""WITH {V.VALIDATION_SQL} SELECT id, '{{"submission":' || submission || ',"standard":"' || standard || '","spec":"' || spec || '"}}' AS body, 'X-API-Key' AS header FROM validation WHERE status = 'pending'""",
)
def _(t):
    """What would be posted; sending is left to foreachBatch."""
    pending = V.validations(t).where("status = 'pending'")
    return pending.select("id", F.to_json(F.struct("submission", "standard", "spec")).alias("body"), F.lit("X-API-Key").alias("header"))


PAYLOAD_SQL = """payload AS (SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '{"jobId":"' || event_id || '","rating":' || (event_id % 13) || ',"title":"T","tags":["a","b"],"teamId":"7","teamName":"red"}'
  WHEN 1 THEN '{"jobId":"n' || event_id || '","score":{"score":' || (event_id % 11) || ',"reasoning":"why"},"job":{"jobName":"","jobType":"Fixed","paymentVerified":true}}'
  WHEN 2 THEN '{"title":"","price":"$5","paymentVerified":false}'
  WHEN 3 THEN '{"score":{"score":3},"title":"' || event_type || '","description":"' || user_id || '","scoreValue":' || (event_id % 3) || ',"rating":' || user_id || ',"clientRating":' || value || ',"country":"' || (event_id % 2) || '"}'
  ELSE '{"jobId":"","score":{"score":8},"job":{"jobName":"J","descriptionSnippet":"s","clientRating":4.5}}' END AS j FROM events)"""


def payloads(t):
    s = lambda x: F.col(x).cast("string")
    k, i = F.col("event_id") % 5, s("event_id")
    j = (
        F.when(k == 0, F.concat(F.lit('{"jobId":"'), i, F.lit('","rating":'), (F.col("event_id") % 13).cast("string"), F.lit(',"title":"T","tags":["a","b"],"teamId":"7","teamName":"red"}')))
        .when(k == 1, F.concat(F.lit('{"jobId":"n'), i, F.lit('","score":{"score":'), (F.col("event_id") % 11).cast("string"), F.lit(',"reasoning":"why"},"job":{"jobName":"","jobType":"Fixed","paymentVerified":true}}')))
        .when(k == 2, F.lit('{"title":"","price":"$5","paymentVerified":false}'))
        .when(k == 3, F.concat(F.lit('{"score":{"score":3},"title":"'), "event_type", F.lit('","description":"'), s("user_id"), F.lit('","scoreValue":'), (F.col("event_id") % 3).cast("string"), F.lit(',"rating":'), s("user_id"), F.lit(',"clientRating":'), s("value"), F.lit(',"country":"'), (F.col("event_id") % 2).cast("string"), F.lit('"}')))
        .otherwise(F.lit('{"jobId":"","score":{"score":8},"job":{"jobName":"J","descriptionSnippet":"s","clientRating":4.5}}'))
    )
    return t.events.select("event_id", j.alias("j"))


def evaluation_sql() -> str:
    """What P.evaluation() gives, in the DuckDB dialect, by the paths of either layout: a table evaluation."""
    at = lambda path: f"(j ->> '$.{path}')"
    filled = lambda path: f"CASE WHEN {at(path)} NOT IN ('', 'false', 'null') THEN {at(path)} END"
    number = lambda path: f"nullif(TRY_CAST({filled(path)} AS DOUBLE), 0)"
    pick = lambda f, nested, *flat: f"CASE WHEN nested THEN {f(nested)} ELSE coalesce({', '.join(map(f, flat))}) END"
    columns = [f"{filled('jobId')} AS job_id", *(f"coalesce({pick(filled, a, b)}, '') AS {name}" for name, a, b in P.TEXT_FIELDS)]
    columns += [f"{pick(number, 'score.score', 'rating')} AS rating", f"{pick(number, 'score.score', 'scoreValue', 'rating')} AS score_value", f"{pick(number, 'job.clientRating', 'clientRating')} AS client_rating"]
    columns += [f"{pick(filled, 'job.paymentVerified', 'paymentVerified')} IS NOT NULL AS payment_verified", f"coalesce({pick(filled, 'job.tags', 'tags')}, '[]') AS tags", f"{filled('teamId')} AS team_id", f"{filled('teamName')} AS team_name"]
    return f"read AS (SELECT event_id, CAST(j AS JSON) AS j, (j -> '$.score') IS NOT NULL AND (j -> '$.job') IS NOT NULL AS nested FROM payload), evaluation AS (SELECT event_id, {', '.join(columns)} FROM read)"


@query("payload_normalised", "JSON", f"WITH {PAYLOAD_SQL}, {evaluation_sql()} SELECT * FROM evaluation")
def _(t):
    return payloads(t).select("event_id", F.inline(F.array(P.evaluation(F.col("j")))))  # a generator: evaluated once, not for each field


@query(
    "payload_findings", "JSON",
    f"""WITH {PAYLOAD_SQL}, {evaluation_sql()} SELECT e.event_id, CASE WHEN job_id IS NULL AND title = '' THEN 'neither jobId nor title' ELSE '' END AS errors,
  concat_ws('; ', CASE WHEN title = '' THEN 'title is missing' END, CASE WHEN description = '' THEN 'description is missing' END, CASE WHEN team_id IS NOT NULL AND team_name IS NOT NULL THEN 'teamId goes before teamName' END) AS warnings,
  list_aggregate(list_sort(json_keys(j)), 'string_agg', ',') AS fields FROM evaluation e JOIN payload p ON p.event_id = e.event_id""",
)
def _(t):
    found = payloads(t).select("event_id", P.evaluation_findings(F.col("j")).alias("f"), F.array_join(F.sort_array(F.json_object_keys("j")), ",").alias("fields"))
    return found.select("event_id", F.array_join("f.errors", "; ").alias("errors"), F.array_join("f.warnings", "; ").alias("warnings"), "fields")


@query(
    "payload_upsert", "JSON SK3 JN13",
    f"""WITH {PAYLOAD_SQL}, n AS (SELECT nullif(j ->> '$.jobId', '') AS id, CASE WHEN event_id % 5 = 0 THEN 'T' END AS title, j ->> '$.teamName' AS team FROM payload),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'blue' END AS team FROM orders)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title, coalesce(o.team, n.team) AS team FROM o FULL JOIN (SELECT * FROM n WHERE id IS NOT NULL) n ON o.id = n.id""",
)
def _(t):
    """Jobs by id: filled fields overwrite, but the team that a job has stays."""
    e = payloads(t).select(P.evaluation(F.col("j")).alias("e")).where("e.job_id is not null")
    new = e.select(F.col("e.job_id").alias("id"), S.blank_to_null(F.col("e.title")).alias("title"), F.col("e.team_name").alias("team"))
    old = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, "blue").alias("team"))
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    return joined.select(F.coalesce("n.id", "o.id").alias("id"), F.coalesce("n.title", "o.title").alias("title"), F.coalesce("o.team", "n.team").alias("team"))


#: Payloads of a job feed, one of them for each order (@: its key): full, sparse, of the other skills' shape, and broken ones.
FEED = [
    '{"type":"x","data":{"teamName":"red","teamId":"t1","scannerName":"s","scannerId":7,"job":{"ciphertext":"~01@","title":"A @","duration":"1 month","engagement":"part","experienceLevel":2,"categoryName":"Web","subCategoryName":"Data","connectsPrice":8,"talentPreference":"any","createdOn":"2024-01-02","questions":["why","how"],"budget":{"type":1,"fixed":@},"client":{"location":{"country":"DE","city":"Ulm","timezone":"CET"},"paymentVerified":true,"stats":{"totalSpent":@.5,"feedbackScore":4.5,"hireRate":0.5,"totalHires":3,"jobsPostedCount":9},"company":{"industry":"IT","size":10,"isEnterprise":true}},"skills":[{"name":"sql"},{"name":"s@"}]}}}',
    '{"data":{"job":{"title":"","description":"d @","budget":{"type":2,"hourlyMin":2@,"hourlyMax":40}}}}',
    '{"data":{"job":{"ciphertext":"~@","budget":{"type":2,"hourlyMin":15,"hourlyMax":0}}}}',
    '{"data":{"teamName":"x@"}}',
    '{"type":"y"}',
    '{"data":{"job":{"ciphertext":"~06","title":"false","description":"null","duration":"0","engagement":false,"budget":{"type":"1","fixed":5},"skills":[{"name":"sql"}],"client":{"paymentVerified":"false","stats":{"totalSpent":"7","hireRate":0}}}}}',
    '{"data":{"job":{"ciphertext":"~07","skills":["sql","more @"],"questions":[],"budget":{"type":1,"fixed":0}}}}',
    '{"data":{"job":{"ciphertext":"~08","skills":[{"name":""},{"name":"a"},"b"],"budget":null,"client":null}}}',
    '{"data":{"job":null}}',
    'no payload',
    None,
]


def feed_sql() -> str:
    """What feed_jobs computes, in the DuckDB dialect, from the same payloads."""
    raw = lambda p: f"CAST((j -> '$.data.{p}') AS VARCHAR)"
    at = lambda p: f"CASE WHEN {raw(p)} NOT IN ('\"\"', 'false', 'null', '0') THEN (j ->> '$.data.{p}') END"
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    columns = [f"coalesce({at('job.' + p)}, '') AS {name}" for name, p in P.FEED_TEXTS] + [f"coalesce({at(p)}, '') AS {name}" for name, p in P.FEED_SOURCE]
    columns += [f"TRY_CAST({at('job.' + p)} AS DOUBLE) AS {name}" for name, p in P.FEED_NUMBERS] + [f"coalesce(TRY_CAST({at('job.' + p)} AS DOUBLE), 0) AS {name}" for name, p in P.FEED_AMOUNTS]
    columns += [f"{at('job.' + p)} IS NOT NULL AS {name}" for name, p in P.FEED_FLAGS]
    fixed, low, high = (at(f"job.budget.{x}") for x in ("fixed", "hourlyMin", "hourlyMax"))
    columns += [
        f"coalesce('https://jobs.example.com/' || {at('job.ciphertext')}, '') AS url", f"CASE WHEN {raw('job.budget.type')} = '1' THEN 'Fixed' ELSE 'Hourly' END AS job_type",
        f"coalesce(CASE {raw('job.budget.type')} WHEN '1' THEN '$' || {fixed} || ' Fixed' WHEN '2' THEN coalesce('$' || {low} || '-$' || {high} || '/hr', '$' || {low} || '+/hr') END, '') AS price",
        "CAST(to_json(list_transform(coalesce(CAST((j -> '$.data.job.skills') AS JSON[]), []), lambda s: coalesce(nullif((s ->> '$.name'), ''), (s ->> '$')))) AS VARCHAR) AS skills",
        f"coalesce({at('job.questions')}, '[]') AS questions", "body AS raw",
    ]
    body = f"replace(list_extract([{', '.join(map(quoted, FEED))}], CAST(o_orderkey % {len(FEED)} AS INTEGER) + 1), '@', CAST(o_orderkey AS VARCHAR))"
    return f"""WITH feed AS (SELECT id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM (SELECT o_orderkey AS id, {body} AS body FROM orders)),
jobs AS (SELECT id, {", ".join(columns)} FROM feed WHERE {raw("job")} <> 'null')
SELECT feed.id, jobs.* EXCLUDE (id), CASE WHEN (j -> '$.data') IS NULL THEN 'data is missing' WHEN jobs.id IS NULL THEN 'job is missing' WHEN jobs.ciphertext = '' THEN 'ciphertext is missing' END AS error
FROM feed LEFT JOIN jobs ON feed.id = jobs.id"""


@query("feed_jobs", "JSON", feed_sql())
def _(t):
    j = F.replace(F.get(F.array(*map(F.lit, FEED)), (F.col("o_orderkey") % len(FEED)).cast("int")), F.lit("@"), F.col("o_orderkey").cast("string"))
    feed = t.orders.select(F.col("o_orderkey").alias("id"), j.alias("j"))
    return P.feed_jobs(feed, "j", "https://jobs.example.com/").select("id", "job.*", "error")


@query("payload_props", "JSON", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props ->> '$.k' AS BIGINT) + 1 AS next_k FROM events")
def _(t):
    variant = F.parse_json("props")
    k = F.variant_get(variant, "$.k", "long")
    return t.events.select("event_id", k.alias("k"), (k + 1).alias("next_k"))


@query("price_texts", "JSON", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$' || p_size || ' Fixed' WHEN 1 THEN '$' || p_size || '-$' || (p_size + 5) || '/hr' WHEN 2 THEN '$' || p_size || '+/hr' ELSE '' END AS price FROM part")
def _(t):
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    kind = F.when(k == 0, "1").when(k == 3, "3").otherwise("2")
    return t.part.select("p_partkey", P.price(kind, size.cast("string"), size.cast("string"), F.when(k == 1, (size + 5).cast("string"))).alias("price"))


@query(
    "error_classes", "JSON SM2",
    """WITH c AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'database' WHEN 1 THEN 'validation' WHEN 2 THEN 'authentication' WHEN 3 THEN CASE WHEN value > 30 THEN 'validation' ELSE 'unknown' END WHEN 4 THEN 'file_operation' WHEN 5 THEN 'external_service' WHEN 6 THEN 'database' ELSE 'unknown' END AS category FROM events)
SELECT event_id, category, CASE category WHEN 'database' THEN 'high' WHEN 'validation' THEN 'low' WHEN 'file_operation' THEN 'high' WHEN 'external_service' THEN 'high' ELSE 'medium' END AS severity FROM c""",
)
def _(t):
    k = (F.col("event_id") % 8).cast("int")
    listed = lambda xs: F.get(F.array(*map(F.lit, xs)), k)
    name = listed(["MongoServerError", "CastError", "TokenExpiredError", "ValidationError", "Error", "Error", "MongoError", "Error"])
    code = listed([None, None, "ENOENT", None, "EACCES", "ETIMEDOUT", "ECONNREFUSED", "EPIPE"])
    category = P.error_category(name, code, F.col("value") > 30)
    return t.events.select("event_id", category.alias("category")).withColumn("severity", P.error_severity(F.col("category")))


@query(
    "scalar_functions", "FN",
    """SELECT s_suppkey, sha256(s_name) AS sha, md5(s_name) AS md, to_base64(encode(repeat(s_name, 20))) AS b64, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS padded, upper(s_name) AS up, starts_with(s_name, 'Supplier#00000001') AS starts,
  CAST(floor(s_acctbal + 0.5) AS BIGINT) AS rounded, CAST(ceil(s_acctbal) AS BIGINT) AS up_to, list_aggregate(list_sort(list_distinct(string_split(s_name, '0'))), 'string_agg', '|') AS parts FROM supplier""",
)
def _(t):
    n = F.col("s_name")
    return t.supplier.select(
        "s_suppkey", F.sha2(n.cast("binary"), 256).alias("sha"), F.md5(n.cast("binary")).alias("md"), S.base64_line(F.repeat(n, F.lit(20)).cast("binary")).alias("b64"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("padded"),
        F.upper(n).alias("up"), n.startswith("Supplier#00000001").alias("starts"), S.round_half_up(F.col("s_acctbal")).alias("rounded"), F.ceil("s_acctbal").cast("long").alias("up_to"),
        F.array_join(F.sort_array(F.array_distinct(F.split(n, "0"))), "|").alias("parts"),
    )


@query(
    "array_edits", "FN",
    f"WITH {V.POST_SQL} SELECT id, array_to_string(CASE WHEN list_contains(tags, 'high') THEN list_filter(tags, lambda x: x <> 'high') ELSE list_append(tags, 'high') END, ',') AS toggled, array_to_string(list_reverse(platforms), ',') AS reversed, len(tags) + len(platforms) AS n FROM post",
)
def _(t):
    return V.posts(t).select("id", F.array_join(S.toggled(F.col("tags"), F.lit("high")), ",").alias("toggled"), F.array_join(F.reverse("platforms"), ",").alias("reversed"), F.size(F.concat("tags", "platforms")).cast("long").alias("n"))


@query(
    "map_edits", "FN",
    f"WITH {V.POST_SQL} SELECT id, 'new ' || status AS x, CASE WHEN id % 2 = 1 THEN title END AS facebook, CASE WHEN id % 2 = 1 THEN 2 ELSE 2 END::BIGINT AS n FROM post",
)
def _(t):
    new = F.create_map(F.lit("x"), F.concat(F.lit("new "), F.col("status")))
    kept = F.map_filter("content", lambda k, v: k != "x")  # the new value replaces that of the same key
    merged = F.map_concat(kept, new)
    return V.posts(t).select("id", merged["x"].alias("x"), F.try_element_at(merged, F.lit("facebook")).alias("facebook"), F.size(merged).cast("long").alias("n"))


@query(
    "date_functions", "FN",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_later, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
  strftime(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS sunday, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS at_nine FROM orders""",
)
def _(t):
    d = F.to_date("o_orderdate")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    nine = F.make_timestamp(F.year(d), F.month(d), F.day(d), F.lit(9), F.lit(0), F.lit(0))
    return t.orders.select("o_orderkey", day(F.date_sub(d, 7)).alias("week_before"), day(F.add_months(d, 1)).alias("month_later"), day(F.date_trunc("month", d)).alias("month_start"), day(S.week_start(d)).alias("sunday"), F.date_format(nine, "yyyy-MM-dd HH:mm").alias("at_nine"))


@query("activity_kinds", "SM12", f"WITH {V.POST_SQL} SELECT id, CASE WHEN status = 'published' THEN 'published' WHEN scheduled IS NOT NULL THEN 'scheduled' ELSE 'edited' END AS activity FROM post")
def _(t):
    return V.posts(t).select("id", F.when(F.col("status") == "published", "published").when(F.col("scheduled").isNotNull(), "scheduled").otherwise("edited").alias("activity"))


@query(
    "confidence_routing", "SM5",
    "SELECT event_id, value / 100 AS confidence, CASE WHEN event_type <> 'error' AND value / 100 >= 0.5 THEN 'mapped' WHEN event_type <> 'error' THEN 'low confidence' ELSE 'no match' END AS route FROM events",
)
def _(t):
    """Confidences come as percentages."""
    c = F.coalesce(F.col("value"), F.lit(0.0)) / 100
    matched = F.col("event_type") != "error"
    return t.events.select("event_id", c.alias("confidence"), F.when(matched & (c >= 0.5), "mapped").when(matched, "low confidence").otherwise("no match").alias("route"))


@query("repeated_line_keys", "DQ", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.repeated_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query("repeated_active_keys", "DQ", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.repeated_keys(t.orders, "o_custkey", "o_orderpriority", where=F.col("o_orderstatus") == "O")


@query("values_outside", "DQ", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'purchase', 'error', 'view')")
def _(t):
    return Q.outside(t.events, "event_type", ["signup", "purchase", "error", "view"]).select("event_id", "event_type")
