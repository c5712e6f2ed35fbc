"""Domain views over the input tables: validations, votes, tenants, posts, text lines and others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables


def cases(value: Column, pairs: dict, other=None) -> Column:
    """The value of the first equal key."""
    out = None
    for k, v in pairs.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def validations(t: Tables) -> DataFrame:
    """id, submission, standard, spec, ts, status: attempts at validating a section."""
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("submission"),
        (F.col("user_id") % 21 + 1).cast("string").alias("standard"),
        F.char(97 + F.col("event_id") % 4).alias("spec"),
        "ts",
        cases(F.col("event_type"), {"error": "fail", "purchase": "pass"}, "pending").alias("status"),
    )


def votes(t: Tables) -> DataFrame:
    """standard, spec, compliance: a reviewer's vote on a section; null where not given."""
    vote = cases(F.col("l_returnflag"), {"A": "compliant", "R": "non_compliant"}, "not_applicable")
    return t.lineitem.select(F.col("l_partkey").alias("standard"), F.col("l_suppkey").alias("spec"), F.when(F.col("l_quantity") <= 45, vote).alias("compliance"))


def comments(t: Tables) -> DataFrame:
    """id, standard, spec, unresolved, ts, text."""
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("standard"), F.col("event_type").alias("spec"), (F.col("value") < 10).alias("unresolved"), "ts", F.col("props").alias("text"))


def errors(t: Tables) -> DataFrame:
    """id, category, severity, fingerprint, ts, message."""
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "medium").otherwise("low")
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), severity.alias("severity"), F.md5(F.concat_ws(":", "event_type", F.substring("props", 1, 100)).cast("binary")).alias("fingerprint"), "ts", F.col("props").alias("message"), "user_id")


def evidence(t: Tables) -> DataFrame:
    """id, kind, size, linked_label: documents, with the label row that they are linked to."""
    kind = cases(F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(3)), {0: "document", 1: "image"}, "url")
    linked = t.labels.select("doc_id", F.col("quality").alias("linked_label"))
    return t.documents.select("doc_id", kind.alias("kind"), F.col("n_chars").alias("size"), "lang").join(linked, "doc_id", "left").withColumnRenamed("doc_id", "id")


def tenants(t: Tables) -> DataFrame:
    """customer rows with tenant: the market segment, null where the balance is negative."""
    return t.customer.withColumn("tenant", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))


def posts(t: Tables) -> DataFrame:
    """id, status, scheduled (null for drafts), tags, platforms, content (a map by platform)."""
    orders = t.orders
    status = cases(F.col("o_orderstatus"), {"F": "published", "O": "ready"}, "draft")
    tags = F.split(F.lower(F.regexp_replace("o_orderpriority", r"^\d-", "")), " ")
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority"))
    return orders.select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        F.when(status != "draft", F.col("o_orderdate")).alias("scheduled"),
        tags.alias("tags"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"), F.lit("linkedin"))).otherwise(F.array(F.lit("facebook"))).alias("platforms"),
        F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("x"), F.lit(""), F.lit("linkedin"), title)).otherwise(F.create_map(F.lit("facebook"), title)).alias("content"),
        F.col("o_custkey").alias("folder"),
    )


#: The lines of the derived text view, by event_id % 12; None are filled in below.
LINES = [
    None, None, "the program mission and measurable program goals", "a\tb\tc", "- list item", None, "3.b field placement sites",
    "Course\tCredit\tSemester", "budget, facilities and library", " ", "12", "ethical standards and confidentiality",
]


def text_lines(t: Tables) -> DataFrame:
    """doc, n, line: a document per user, a line per event."""
    c = F.col("event_id")
    filled = {
        0: F.concat(F.lit("Page "), (c % 7 + 1).cast("string")),
        1: F.concat(F.lit("Standard "), (c % 21 + 1).cast("string"), F.char(97 + c % 4), F.lit(" faculty credentials")),
        5: F.concat(F.lit("STANDARD "), (c % 10 + 1).cast("string"), F.lit(": PROGRAM IDENTITY")),
    }
    line = cases(c % 12, {i: filled.get(i, x) for i, x in enumerate(LINES)})
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return t.events.select(F.col("user_id").alias("doc"), n.alias("n"), line.alias("line"))


# The same views for the SQL oracles, as common table expressions.
VALIDATION_SQL = """validation AS (SELECT event_id AS id, user_id AS submission, CAST(user_id % 21 + 1 AS VARCHAR) AS standard,
  chr(CAST(97 + event_id % 4 AS INTEGER)) AS spec, ts, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' ELSE 'pending' END AS status FROM events)"""
VOTE_SQL = """vote AS (SELECT l_partkey AS standard, l_suppkey AS spec, CASE WHEN l_quantity > 45 THEN NULL WHEN l_returnflag = 'A' THEN 'compliant'
  WHEN l_returnflag = 'R' THEN 'non_compliant' ELSE 'not_applicable' END AS compliance FROM lineitem)"""
COMMENT_SQL = "comment AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS standard, event_type AS spec, value < 10 AS unresolved, ts, props AS text FROM events)"
ERROR_SQL = """error AS (SELECT event_id AS id, event_type AS category, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high'
  WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity, md5(event_type || ':' || substr(props, 1, 100)) AS fingerprint, ts, props AS message, user_id FROM events)"""
EVIDENCE_SQL = """evidence AS (SELECT d.doc_id AS id, CASE CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'image' ELSE 'url' END AS kind,
  n_chars AS size, l.quality AS linked_label, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TENANT_SQL = "tenant AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS tenant FROM customer)"
POST_SQL = """post AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'ready' ELSE 'draft' END AS status,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END AS scheduled, string_split(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), ' ') AS tags,
  CASE WHEN o_orderkey % 2 = 0 THEN ['x', 'linkedin'] ELSE ['facebook'] END AS platforms, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title, o_custkey AS folder FROM orders)"""
LINE_SQL = """text_line AS (SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n,
  CASE event_id % 12 WHEN 0 THEN 'Page ' || (event_id % 7 + 1) WHEN 1 THEN 'Standard ' || (event_id % 21 + 1) || chr(CAST(97 + event_id % 4 AS INTEGER)) || ' faculty credentials'
  WHEN 2 THEN 'the program mission and measurable program goals' WHEN 3 THEN 'a' || chr(9) || 'b' || chr(9) || 'c' WHEN 4 THEN '- list item'
  WHEN 5 THEN 'STANDARD ' || (event_id % 10 + 1) || ': PROGRAM IDENTITY' WHEN 6 THEN '3.b field placement sites' WHEN 7 THEN 'Course' || chr(9) || 'Credit' || chr(9) || 'Semester'
  WHEN 8 THEN 'budget, facilities and library' WHEN 9 THEN ' ' WHEN 10 THEN '12' ELSE 'ethical standards and confidentiality' END AS line FROM events)"""
