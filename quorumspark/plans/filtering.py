"""Filters, access rules and projections as queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import filters as O
from ..operators import payload as P
from ..registry import query
from ..sources import views as V

NOW = datetime.datetime(2024, 1, 17, 12, 0, 0)
ORDER_NOW = datetime.datetime(1998, 6, 17, 12, 0, 0)


@query("filter_optional_terms", "FL1 PR1", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 42")
def _(t):
    return O.optional(t.orders, o_orderstatus="F", o_orderpriority="", o_custkey=42, o_totalprice=0).select("o_orderkey", "o_orderstatus")


@query("filter_in_list", "FL2 AG26", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("filter_not_in_keeps_null", "FL3", f"WITH {V.TENANT_SQL} SELECT c_custkey, tenant FROM tenant WHERE tenant IS NULL OR tenant NOT IN ('BUILDING', 'MACHINERY')")
def _(t):
    return V.tenants(t).where(S.not_in(F.col("tenant"), ["BUILDING", "MACHINERY"])).select("c_custkey", "tenant")


@query("filter_not_equal_keeps_null", "FL4", f"WITH {V.TENANT_SQL} SELECT c_custkey, tenant FROM tenant WHERE tenant IS DISTINCT FROM 'BUILDING'")
def _(t):
    return V.tenants(t).where(S.not_equal(F.col("tenant"), "BUILDING")).select("c_custkey", "tenant")


@query("filter_date_range", "FL5", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-03-31'")
def _(t):
    return t.orders.where(F.col("o_orderdate").between(datetime.datetime(1998, 1, 1), datetime.datetime(1998, 3, 31))).select("o_orderkey", "o_custkey")


@query("filter_greater_than", "FL6", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey HAVING count(*) > 20")
def _(t):
    return t.lineitem.where("l_discount > 0.05").groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 20")


@query("filter_exists", "FL7", f"WITH {V.TENANT_SQL} SELECT tenant IS NOT NULL AS assigned, count(*) AS n FROM tenant GROUP BY 1")
def _(t):
    return V.tenants(t).groupBy(F.col("tenant").isNotNull().alias("assigned")).agg(F.count("*").alias("n"))


@query("filter_either", "FL8", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def _(t):
    return t.customer.where((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0)).select("c_custkey")


@query("filter_two_fields", "FL9", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = l_linenumber")
def _(t):
    return t.lineitem.where(F.col("l_suppkey") == F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("filter_regex_any_field", "FL10", f"WITH {V.ERROR_SQL} SELECT id FROM error WHERE regexp_matches(category, 'SIGN|^err', 'i') OR regexp_matches(message, 'SIGN|^err', 'i')")
def _(t):
    p = "SIGN|^err"
    return V.errors(t).where(S.matches(F.col("category"), p) | S.matches(F.col("message"), p)).select("id")


@query("filter_name_ignoring_case", "FL11 JN14", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = lower('Blue ANVIL')")
def _(t):
    return t.part.where(F.lower("p_name") == "Blue ANVIL".lower()).select("p_partkey", "p_name")


@query("filter_prefix", "FL12", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def _(t):
    return t.customer.where(F.col("c_name").startswith("Customer#0000000")).select("c_custkey", "c_name")


@query("filter_regex_or_text", "FL13", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue)', 'i') OR contains(lower(p_brand), lower('#2('))")
def _(t):
    return t.part.where(S.matches(F.col("p_name"), "^(red|blue)") | S.matches(F.col("p_brand"), "#2(")).select("p_partkey")


@query("filter_text_in_any_column", "FL14", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring')")
def _(t):
    return t.part.where(O.any_contains("RING", F.col("p_name"), F.col("p_type"), F.col("p_brand"))).select("p_partkey")


@query("filter_text_in_map_or_array", "FL15", f"WITH {V.POST_SQL} SELECT id FROM post WHERE contains(lower(title), 'order 12') OR len(list_filter(tags, lambda x: contains(x, 'order 12'))) > 0")
def _(t):
    return V.posts(t).where(O.any_element_contains("Order 12", F.map_values("content"), F.col("tags"))).select("id")


@query("filter_array_holds", "FL16", f"WITH {V.POST_SQL} SELECT id FROM post WHERE list_contains(platforms, 'linkedin') AND status = 'ready'")
def _(t):
    return V.posts(t).where(F.array_contains("platforms", "linkedin") & (F.col("status") == "ready")).select("id")


@query("filter_arrays_overlap", "FL17", f"WITH {V.POST_SQL} SELECT id FROM post WHERE list_has_any(tags, ['urgent', 'specified'])")
def _(t):
    return V.posts(t).where(F.arrays_overlap("tags", F.array(F.lit("urgent"), F.lit("specified")))).select("id")


@query("filter_nested_path", "FL18", f"WITH {V.VALIDATION_SQL} SELECT id, status FROM validation WHERE status = 'fail' AND standard = '3'")
def _(t):
    nested = V.validations(t).select("id", "standard", F.struct("status", "ts").alias("result"))
    return nested.where((F.col("result.status") == "fail") & (F.col("standard") == "3")).select("id", "result.status")


@query("filter_next_days", "FL19", f"WITH {V.POST_SQL} SELECT id FROM post WHERE scheduled BETWEEN TIMESTAMP '{ORDER_NOW}' AND TIMESTAMP '{ORDER_NOW}' + INTERVAL 30 DAY")
def _(t):
    return V.posts(t).where(O.within_days(F.col("scheduled"), F.lit(ORDER_NOW), 30)).select("id")


@query(
    "filter_calendar_periods", "FL20",
    """SELECT event_id, CAST(ts AS DATE) = DATE '2024-01-17' AS today, CAST(ts AS DATE) >= DATE '2024-01-14' AND CAST(ts AS DATE) < DATE '2024-01-21' AS this_week,
  CAST(ts AS DATE) >= DATE '2024-01-01' AND CAST(ts AS DATE) < DATE '2024-02-01' AS this_month,
  CAST(ts AS DATE) >= DATE '2023-12-01' AND CAST(ts AS DATE) < DATE '2024-01-01' AS last_month FROM events""",
)
def _(t):
    return t.events.select("event_id", *(O.calendar(F.col("ts"), p, F.lit(NOW)).alias(p) for p in ("today", "this_week", "this_month", "last_month")))


@query("filter_one_day", "FL21", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def _(t):
    return t.events.where(F.to_date("ts") == datetime.date(2024, 1, 5)).select("event_id")


@query("filter_expired", "FL22", f"WITH {V.POST_SQL} SELECT id, coalesce(scheduled < TIMESTAMP '{ORDER_NOW}', false) AS expired FROM post")
def _(t):
    return V.posts(t).select("id", O.expired(F.col("scheduled"), F.lit(ORDER_NOW)).alias("expired"))


@query("filter_due_now", "FL23", f"WITH {V.POST_SQL} SELECT id FROM post WHERE scheduled <= TIMESTAMP '{ORDER_NOW}' AND status = 'ready'")
def _(t):
    return V.posts(t).where((F.col("scheduled") <= ORDER_NOW) & (F.col("status") == "ready")).select("id")


@query("filter_linked_split", "FL24", f"WITH {V.EVIDENCE_SQL} SELECT linked_label IS NOT NULL AS linked, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM evidence GROUP BY 1")
def _(t):
    return V.evidence(t).groupBy(F.col("linked_label").isNotNull().alias("linked")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query(
    "filter_row_access", "FL25 FL27 JN6",
    """WITH readers AS (SELECT n_regionkey AS region, list(n_nationkey) AS reader_ids FROM nation GROUP BY 1)
SELECT c_custkey, n_regionkey = 2 AS coordinator_sees, list_contains(reader_ids, 7) AS reader_sees, true AS admin_sees, false AS guest_sees
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN readers ON region = n_regionkey""",
)
def _(t):
    readers = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list("n_nationkey").alias("reader_ids"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(readers, F.col("n_regionkey") == F.col("region"))
    sees = lambda role: O.visible(role, institution=F.col("n_regionkey"), own_institution=2, reader_ids=F.col("reader_ids"), user=7).alias(f"{role}_sees")
    return rows.select("c_custkey", *map(sees, ("coordinator", "reader", "admin", "guest")))


@query(
    "filter_by_access_table", "FL25 JN6",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4)""",
)
def _(t):
    mine = t.customer.where((F.col("c_nationkey") == 3) | ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 4)))
    return t.orders.join(mine.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("filter_tenant_scope", "FL26", f"WITH {V.TENANT_SQL} SELECT c_custkey, tenant FROM tenant WHERE tenant IS NULL OR tenant = 'FURNITURE'")
def _(t):
    return V.tenants(t).where(O.in_team(F.col("tenant"), "FURNITURE")).select("c_custkey", "tenant")


@query("filter_role_and_terms", "FL27", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'HOUSEHOLD'")
def _(t):
    scope = F.col("c_nationkey") == 5  # what the role sees; terms of the request only narrow it
    return O.optional(t.customer.where(scope), c_mktsegment="HOUSEHOLD").select("c_custkey")


@query(
    "filter_posts", "FL28",
    f"WITH {V.POST_SQL} SELECT id FROM post WHERE status = 'ready' AND list_has_any(platforms, ['linkedin']) AND list_has_any(tags, ['urgent', 'high']) AND contains(lower(title), '7')",
)
def _(t):
    found = O.optional(V.posts(t), status="ready", folder=None)
    wanted = lambda xs: F.array(*map(F.lit, xs))
    return found.where(F.arrays_overlap("platforms", wanted(["linkedin"])) & F.arrays_overlap("tags", wanted(["urgent", "high"])) & O.any_element_contains("7", F.map_values("content"))).select("id")


@query(
    "lock_permissions", "FL29 FL30",
    """SELECT o_orderkey, true AS admin_edits, o_orderstatus <> 'F' AND (o_orderstatus = 'P' OR o_custkey % 10 = 0) AS coordinator_edits,
  o_custkey % 3 = 1 AS reader_edits, o_custkey % 3 = 1 AND (o_orderstatus <> 'F' OR o_orderkey % 4 = 1) AS may_lock, o_orderstatus = 'F' AND o_orderkey % 4 = 1 AS reader_unlocks, o_orderstatus = 'F' AS lead_unlocks FROM orders""",
)
def _(t):
    locked, back, own = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.col("o_custkey") % 10 == 0
    may = lambda role: O.may_edit(role, locked=locked, sent_back=back, own=own, readers=F.array(F.col("o_custkey") % 3), user=F.lit(1).cast("long")).alias(f"{role}_edits")
    by, user = F.col("o_orderkey") % 4, F.lit(1).cast("long")
    lock = O.may_lock(locked=locked, locked_by=by, readers=F.array(F.col("o_custkey") % 3), user=user)
    unlock = lambda role: O.may_unlock(role, locked=locked, locked_by=by, user=user)
    return t.orders.select("o_orderkey", *map(may, ("admin", "coordinator", "reader")), lock.alias("may_lock"), unlock("reader").alias("reader_unlocks"), unlock("lead_reader").alias("lead_unlocks"))


@query("project_without_columns", "PR2", "SELECT p_partkey, p_brand, p_type, CAST(p_size AS INTEGER) AS p_size FROM part WHERE p_size > 40")
def _(t):
    nested = t.part.select("p_partkey", F.struct("p_name", "p_brand", "p_type", "p_size", "p_retailprice").alias("file"))
    return nested.withColumn("file", F.col("file").dropFields("p_name", "p_retailprice")).select("p_partkey", "file.*").where("p_size > 40")


@query("project_derived", "PR3 PR4", "SELECT o_orderkey, o_totalprice > 300000 AS large, o_orderstatus = 'F' AS done, o_totalprice > 300000 AND o_orderstatus = 'F' AS large_and_done FROM orders")
def _(t):
    derived = t.orders.withColumns({"large": F.col("o_totalprice") > 300000, "done": F.col("o_orderstatus") == "F"})
    return derived.withColumn("large_and_done", F.col("large") & F.col("done")).select("o_orderkey", "large", "done", "large_and_done")


@query("project_struct_as_row", "PR5", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.struct("n_nationkey", "n_name", "r_name").alias("latest")).select("latest.*")


@query("project_full_name", "PR6 PR15", "SELECT c_custkey, concat_ws(' ', c_name, nullif(c_mktsegment, 'BUILDING')) AS full_name, c_nationkey || '.' || c_custkey AS dotted FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat_ws(" ", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("full_name"), F.concat_ws(".", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("dotted"))


@query("project_masked", "PR7", "SELECT s_suppkey, repeat('*', length(s_name) - 4) || right(s_name, 4) AS masked, substr(s_name, 1, 4) || '...' || right(s_name, 4) AS ends FROM supplier")
def _(t):
    name = F.col("s_name")
    return t.supplier.select("s_suppkey", S.masked(name).alias("masked"), F.concat(F.substring(name, 1, 4), F.lit("..."), F.right(name, F.lit(4))).alias("ends"))


@query(
    "project_redacted_fields", "PR7",
    "SELECT event_id, '[REDACTED]' AS user_password, event_type AS kind, props AS api_key, '[REDACTED]' AS api_key_too FROM events",
)
def _(t):
    """The rule leaves API keys as they are; the second form hides them, too."""
    fields = F.create_map(F.lit("userPassword"), F.col("props"), F.lit("kind"), F.col("event_type"), F.lit("apiKey"), F.col("props"))
    rows = t.events.select("event_id", P.redacted(fields).alias("m"), P.redacted(fields, also=("apikey",)).alias("s"))
    return rows.select("event_id", F.col("m")["userPassword"].alias("user_password"), F.col("m")["kind"].alias("kind"), F.col("m")["apiKey"].alias("api_key"), F.col("s")["apiKey"].alias("api_key_too"))


@query("project_preview", "PR8", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", S.shortened(F.col("text"), 50).alias("preview"))


@query("project_first_filled", "PR9 PR14", f"WITH {V.POST_SQL} SELECT id, title AS shown, CAST(length(title) AS BIGINT) AS n_chars FROM post")
def _(t):
    content = F.col("content")
    total = F.aggregate(F.map_values(content), F.lit(0), lambda a, x: a + F.length(x)).cast("long")
    return V.posts(t).select("id", S.first_filled(F.try_element_at(content, F.lit("x")), F.try_element_at(content, F.lit("linkedin")), F.try_element_at(content, F.lit("facebook"))).alias("shown"), total.alias("n_chars"))


@query(
    "project_phone", "PR10",
    """WITH d AS (SELECT c_custkey, substr(regexp_replace(CAST(c_custkey * 7919 AS VARCHAR) || '-' || c_nationkey, '[^0-9]', '', 'g'), 1, 10) AS d FROM customer)
SELECT c_custkey, CASE WHEN length(d) <= 3 THEN '(' || d WHEN length(d) <= 6 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3)
 ELSE '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone FROM d""",
)
def _(t):
    raw = F.concat((F.col("c_custkey") * 7919).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", S.phone(raw).alias("phone"))


@query(
    "project_urgency", "PR11",
    f"""WITH {V.POST_SQL}, d AS (SELECT id, CAST(ceil((epoch(scheduled) - epoch(TIMESTAMP '{ORDER_NOW}')) / 86400) AS BIGINT) AS days FROM post WHERE scheduled IS NOT NULL)
SELECT id, days, CASE WHEN days <= 14 THEN 'urgent' WHEN days <= 30 THEN 'warning' ELSE 'normal' END AS band FROM d""",
)
def _(t):
    days = S.days_until(F.col("scheduled").cast("timestamp"), F.lit(ORDER_NOW))
    return V.posts(t).where("scheduled is not null").select("id", days.alias("days")).withColumn("band", S.urgency(F.col("days")))


@query(
    "project_progress_label", "PR12",
    """WITH s AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS done
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'P' THEN 'error' WHEN n = 0 THEN 'parsing' WHEN done = 0 THEN 'analyzing' ELSE 'matching' END AS step,
 CASE WHEN o_orderstatus = 'O' AND done > 0 THEN done || '/' || n END AS received FROM s""",
)
def _(t):
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus")
    s = joined.agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    status = V.cases(F.col("o_orderstatus"), {"F": "completed", "P": "failed"}, "processing")
    step = F.when(status == "completed", "complete").when(status == "failed", "error").when(F.col("n") == 0, "parsing").when(F.col("done") == 0, "analyzing").otherwise("matching")
    return s.select("o_orderkey", step.alias("step"), F.when(step == "matching", F.concat_ws("/", F.col("done").cast("string"), F.col("n").cast("string"))).alias("received"))


@query(
    "project_percent", "PR13",
    """SELECT l_partkey, CAST(floor(count(*) FILTER (WHERE l_returnflag = 'A') * 100 / count(*) + 0.5) AS BIGINT) AS share,
  CAST(floor(count(*) * 100 / nullif(count(*) FILTER (WHERE l_quantity > 49.5), 0) + 0.5) AS BIGINT) AS odd FROM lineitem GROUP BY l_partkey""",
)
def _(t):
    n = F.count("*").alias("n")
    g = t.lineitem.groupBy("l_partkey").agg(n, F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_quantity") > 49.5).alias("b"))
    return g.select("l_partkey", S.percent(F.col("a"), F.col("n")).alias("share"), S.percent(F.col("n"), F.col("b")).alias("odd"))


#: The longest text of each platform.
LIMITS = {"twitter": 280, "linkedin": 4000, "instagram": 2200, "facebook": 63206, "tiktok": 2200}


@query(
    "project_length_limits", "PR16",
    """WITH d AS (SELECT doc_id, length(text) AS n, ['twitter', 'linkedin', 'instagram', 'facebook', 'tiktok', 'other'][doc_id % 6 + 1] AS platform FROM documents)
SELECT doc_id, platform, CASE platform WHEN 'twitter' THEN 280 WHEN 'linkedin' THEN 4000 WHEN 'instagram' THEN 2200 WHEN 'facebook' THEN 63206 WHEN 'tiktok' THEN 2200 END - n AS left_over FROM d""",
)
def _(t):
    limits = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    platform = F.get(F.array(*map(F.lit, [*LIMITS, "other"])), (F.col("doc_id") % 6).cast("int"))
    return t.documents.select("doc_id", platform.alias("platform"), (F.try_element_at(limits, platform) - F.length("text")).cast("long").alias("left_over"))
