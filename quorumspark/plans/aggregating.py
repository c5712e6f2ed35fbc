"""Latest attempts, vote consensus and grouped statistics as queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import consensus as C
from ..operators import latest as L
from ..registry import query
from ..sources import views as V

KEYS = ["submission", "standard", "spec"]
NEWEST = (F.desc, "ts", "id")
LATEST_SQL = f"{V.VALIDATION_SQL}, latest AS (SELECT * FROM validation QUALIFY row_number() OVER (PARTITION BY submission, standard, spec ORDER BY ts DESC, id DESC) = 1)"


def latest_validations(t):
    return L.latest(V.validations(t), KEYS, F.desc("ts"), F.desc("id"))


@query("latest_per_section", "AG5 WN1", f"WITH {LATEST_SQL} SELECT id, submission, standard, spec, status FROM latest")
def _(t):
    return latest_validations(t).drop("ts")


@query("latest_of_submission", "AG5 ST7b", f"WITH {LATEST_SQL} SELECT id, spec, status FROM latest WHERE submission = 17")
def _(t):
    return L.latest(V.validations(t).where("submission = 17"), KEYS, F.desc("ts"), F.desc("id")).select("id", "spec", "status")


@query("latest_status_counts", "AG5b", f"WITH {LATEST_SQL} SELECT submission, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending FROM latest GROUP BY 1")
def _(t):
    n = lambda v, name: F.count_if(F.col("status") == v).alias(name)
    return latest_validations(t).groupBy("submission").agg(n("pass", "passed"), n("fail", "failed"), n("pending", "pending"))


@query("failed_sections_ever", "AG5c", f"WITH {V.VALIDATION_SQL} SELECT id, submission, standard, spec FROM validation WHERE status = 'fail' QUALIFY row_number() OVER (PARTITION BY submission, standard, spec ORDER BY ts DESC, id DESC) = 1")
def _(t):
    return L.latest(V.validations(t).where("status = 'fail'"), KEYS, F.desc("ts"), F.desc("id")).select("id", *KEYS)


@query("failed_sections_now", "AG5c", f"WITH {LATEST_SQL} SELECT id, submission, standard, spec FROM latest WHERE status = 'fail'")
def _(t):
    return latest_validations(t).where("status = 'fail'").select("id", *KEYS)


@query(
    "ready_for_submission", "AG5d",
    f"WITH {LATEST_SQL} SELECT submission, standard, coalesce(string_agg(spec, ',' ORDER BY spec) FILTER (WHERE status <> 'pass'), '') AS failed_specs, count(*) FILTER (WHERE status <> 'pass') = 0 AS ready FROM latest GROUP BY 1, 2",
)
def _(t):
    failed = F.sort_array(F.collect_list(F.when(F.col("status") != "pass", F.col("spec"))))
    g = latest_validations(t).groupBy("submission", "standard").agg(failed.alias("failed"))
    return g.select("submission", "standard", F.array_join("failed", ",").alias("failed_specs"), (F.size("failed") == 0).alias("ready"))


@query(
    "latest_with_attempts", "AG5e AG29",
    f"WITH {V.VALIDATION_SQL} SELECT submission, standard, spec, arg_max(status, (ts, id)) AS status, count(*) AS attempts, count(*) + 1 AS next_attempt FROM validation GROUP BY 1, 2, 3",
)
def _(t):
    g = V.validations(t).groupBy(*KEYS).agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.count("*").alias("attempts"))
    return g.withColumn("next_attempt", F.col("attempts") + 1)


@query(
    "attempt_chain", "JN12 WN2",
    f"WITH {V.VALIDATION_SQL} SELECT id, row_number() OVER w AS attempt, lag(id) OVER w AS previous_id FROM validation WINDOW w AS (PARTITION BY submission, standard, spec ORDER BY ts, id)",
)
def _(t):
    return L.attempts(V.validations(t), KEYS, "id", F.asc("ts"), F.asc("id")).select("id", "attempt", "previous_id")


COUNTS_SQL = f"""{V.VOTE_SQL}, counts AS (SELECT standard, spec, count(*) FILTER (WHERE compliance = 'compliant') AS n_compliant,
  count(*) FILTER (WHERE compliance = 'non_compliant') AS n_non_compliant, count(*) FILTER (WHERE compliance = 'not_applicable') AS n_not_applicable,
  count(compliance) AS n_votes, count(DISTINCT compliance) AS n_different FROM vote GROUP BY 1, 2),
agreed AS (SELECT *, CASE WHEN n_votes = 0 THEN NULL WHEN n_compliant >= n_non_compliant AND n_compliant >= n_not_applicable THEN 'compliant'
  WHEN n_non_compliant >= n_not_applicable THEN 'non_compliant' ELSE 'not_applicable' END AS consensus, n_different > 1 AS disagreement FROM counts)"""


@query("vote_consensus", "AG7 AG8", f"WITH {COUNTS_SQL} SELECT * FROM agreed")
def _(t):
    return C.consensus(V.votes(t), ["standard", "spec"])


@query("vote_disagreements", "AG8 AG12", f"WITH {COUNTS_SQL} SELECT standard, spec, n_different FROM agreed WHERE disagreement")
def _(t):
    return C.consensus(V.votes(t), ["standard", "spec"]).where("disagreement").select("standard", "spec", "n_different")


@query(
    "comparison_view", "AG12",
    f"WITH {COUNTS_SQL} SELECT standard, string_agg(spec || ':' || consensus, ',' ORDER BY spec) AS differing FROM agreed WHERE disagreement GROUP BY 1",
)
def _(t):
    agreed = C.consensus(V.votes(t), ["standard", "spec"])
    nested = agreed.groupBy("standard").agg(F.array_sort(F.collect_list(F.struct("spec", "consensus", "disagreement"))).alias("specs"))
    kept = nested.withColumn("specs", F.filter("specs", lambda s: s["disagreement"])).where(F.size("specs") > 0)
    return kept.select("standard", F.array_join(F.transform("specs", lambda s: F.concat_ws(":", s["spec"].cast("string"), s["consensus"])), ",").alias("differing"))


@query(
    "comment_compilation", "AG9",
    "SELECT user_id, event_type, string_agg('[' || event_id || ']: ' || props, chr(10) || chr(10) ORDER BY ts, event_id) AS compiled FROM events WHERE value > 40 AND trim(props) <> '' GROUP BY 1, 2",
)
def _(t):
    given = t.events.where((F.col("value") > 40) & (S.trimmed(F.col("props")) != ""))
    text = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]: "), F.col("props"))
    lists = given.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", text.alias("text")))).alias("c"))
    return lists.select("user_id", "event_type", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("compiled"))


@query(
    "recommendations", "AG10",
    "SELECT o_orderkey, o_orderstatus AS recommendation, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END, ''), nullif(CASE WHEN o_orderkey % 3 = 1 THEN '' END, ''), CAST(o_custkey AS VARCHAR)) AS details FROM orders WHERE o_orderstatus <> 'P'",
)
def _(t):
    k = F.col("o_orderkey") % 3
    details = S.first_filled(F.when(k == 0, F.col("o_orderpriority")).otherwise(""), F.when(k == 1, ""), F.col("o_custkey").cast("string"))
    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("recommendation"), details.alias("details"))


@query(
    "compliance_statistics", "AG11 AG34",
    f"""WITH {COUNTS_SQL}, decided AS (SELECT *, coalesce(CASE WHEN spec % 50 = 0 THEN 'compliant' END, consensus) AS d FROM agreed)
SELECT standard, count(*) AS total, count(*) FILTER (WHERE d = 'compliant') AS compliant, count(*) FILTER (WHERE d = 'non_compliant') AS non_compliant,
  count(*) FILTER (WHERE d = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE disagreement) AS disagreements,
  CAST(floor(count(*) FILTER (WHERE d = 'compliant') * 100 / nullif(count(*) - count(*) FILTER (WHERE d = 'not_applicable'), 0) + 0.5) AS BIGINT) AS compliance_rate
FROM decided GROUP BY 1""",
)
def _(t):
    final = F.when(F.col("spec") % 50 == 0, "compliant")  # a lead's own determination goes before the consensus
    return C.statistics(C.consensus(V.votes(t), ["standard", "spec"]), ["standard"], F.coalesce(final, F.col("consensus")))


@query(
    "vote_strings", "AG13 SK9",
    f"""WITH {V.VOTE_SQL} SELECT standard, spec, string_agg(standard || ': ' || coalesce(compliance, 'none'), '; ' ORDER BY coalesce(compliance, 'none')) AS votes,
  standard || ',' || spec || ',"' || string_agg(standard || ': ' || coalesce(compliance, 'none'), '; ' ORDER BY coalesce(compliance, 'none')) || '"' AS csv FROM vote GROUP BY 1, 2""",
)
def _(t):
    one = F.concat(F.col("standard").cast("string"), F.lit(": "), F.coalesce("compliance", F.lit("none")))
    g = V.votes(t).groupBy("standard", "spec").agg(F.array_join(F.sort_array(F.collect_list(one)), "; ").alias("votes"))
    quoted = F.concat(F.lit('"'), F.col("votes"), F.lit('"'))
    return g.withColumn("csv", F.concat_ws(",", F.col("standard").cast("string"), F.col("spec").cast("string"), quoted))


CELLS_SQL = """cell AS (SELECT l_partkey AS standard, l_suppkey AS spec, l_suppkey % 5 AS course, max(CASE WHEN l_quantity > 33 THEN 'H' WHEN l_quantity > 16 THEN 'M' ELSE 'L' END) AS depth,
  min(CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'R' THEN 'T' END) AS kind FROM lineitem GROUP BY 1, 2, 3)"""


def cells(t):
    depth = F.when(F.col("l_quantity") > 33, "H").when(F.col("l_quantity") > 16, "M").otherwise("L")
    kind = F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "R", "T")
    c = t.lineitem.select(F.col("l_partkey").alias("standard"), F.col("l_suppkey").alias("spec"), (F.col("l_suppkey") % 5).alias("course"), depth.alias("d"), kind.alias("k"))
    return c.groupBy("standard", "spec", "course").agg(F.max("d").alias("depth"), F.min("k").alias("kind"))


@query(
    "matrix_pivot", "AG14 SK10",
    f"""WITH {CELLS_SQL} SELECT standard, spec, {", ".join(f"coalesce(max(CASE WHEN course = {i} THEN kind || '/' || depth END), '') AS c{i}" for i in range(5))} FROM cell GROUP BY 1, 2""",
)
def _(t):
    value = F.when(F.col("kind").isNotNull() & F.col("depth").isNotNull(), F.concat_ws("/", "kind", "depth"))
    wide = cells(t).withColumn("v", value).groupBy("standard", "spec").pivot("course", [0, 1, 2, 3, 4]).agg(F.first("v", ignorenulls=True))
    return wide.select("standard", "spec", *(F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(f"c{i}") for i in range(5)))


@query(
    "review_progress", "AG15",
    f"WITH {V.VOTE_SQL} SELECT standard, count(*) AS total, count(compliance) AS reviewed, count(*) FILTER (WHERE compliance = 'compliant') AS compliant, count(*) FILTER (WHERE compliance = 'non_compliant') AS non_compliant, count(*) FILTER (WHERE compliance = 'not_applicable') AS not_applicable FROM vote GROUP BY 1",
)
def _(t):
    """Over nested specifications, by higher-order functions."""
    nested = V.votes(t).groupBy("standard").agg(F.collect_list(F.struct("spec", "compliance")).alias("specs"))
    n = lambda test, name: F.size(F.filter("specs", test)).cast("long").alias(name)
    is_ = lambda v: lambda s: F.coalesce(s["compliance"] == v, F.lit(False))
    return nested.select("standard", F.size("specs").cast("long").alias("total"), n(lambda s: s["compliance"].isNotNull(), "reviewed"), *(n(is_(v), v) for v in C.VOTES))


@query(
    "progress_by_standard", "AG16",
    f"WITH {V.VALIDATION_SQL} SELECT submission, standard, count(*) AS total, count(*) FILTER (WHERE status <> 'pending') AS reviewed, CAST(floor(count(*) FILTER (WHERE status <> 'pending') * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM validation GROUP BY 1, 2",
)
def _(t):
    g = V.validations(t).groupBy("submission", "standard").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "pending").alias("reviewed"))
    return g.withColumn("percent", S.percent(F.col("reviewed"), F.col("total")))


@query(
    "missing_items", "AG17",
    f"""WITH {COUNTS_SQL}, m AS (SELECT standard, string_agg('Standard ' || standard || ', Spec ' || spec, ';' ORDER BY spec) FILTER (WHERE consensus IS NULL) AS specs FROM agreed GROUP BY 1)
SELECT standard, concat_ws(';', specs, CASE WHEN standard % 5 = 0 THEN 'Final recommendation' END, CASE WHEN standard % 7 = 0 THEN 'Final strengths' END) AS missing, specs IS NULL AND standard % 5 <> 0 AND standard % 7 <> 0 AS ready FROM m""",
)
def _(t):
    """Sections without a determination, and what of the final assessment is null or blank."""
    nested = C.consensus(V.votes(t), ["standard", "spec"]).groupBy("standard").agg(F.array_sort(F.collect_list(F.struct("spec", "consensus"))).alias("specs"))
    final = nested.withColumns({"recommendation": F.when(F.col("standard") % 5 != 0, "accept"), "strengths": F.when(F.col("standard") % 7 != 0, "many").otherwise(" \n")})
    sections = F.transform(F.filter("specs", lambda s: s["consensus"].isNull()), lambda s: F.concat(F.lit("Standard "), F.col("standard").cast("string"), F.lit(", Spec "), s["spec"].cast("string")))
    rest = F.array_compact(F.array(F.when(F.col("recommendation").isNull(), "Final recommendation"), F.when(F.coalesce(S.trimmed(F.col("strengths")), F.lit("")) == "", "Final strengths")))
    missing = F.concat(sections, rest)
    return final.select("standard", F.array_join(missing, ";").alias("missing"), (F.size(missing) == 0).alias("ready"))


def status_maps(t):
    """A map from standard-spec to the latest status, per submission."""
    return latest_validations(t).groupBy("submission").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "standard", "spec"), "status"))).alias("status"))


@query("progress_over_map", "AG18", f"WITH {LATEST_SQL} SELECT submission, count(*) AS completed, count(*) FILTER (WHERE status <> 'pending') AS validated, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed FROM latest GROUP BY 1")
def _(t):
    each = status_maps(t).select("submission", F.explode("status").alias("section", "status"))
    n = lambda test, name: F.count_if(test).alias(name)
    s = F.col("status")
    return each.groupBy("submission").agg(F.count("*").alias("completed"), n(s != "pending", "validated"), n(s == "pass", "passed"), n(s == "fail", "failed"))


@query(
    "overall_progress", "AG19",
    f"WITH {LATEST_SQL} SELECT submission, CAST(floor(count(*) FILTER (WHERE status = 'pass') * 100 / 21 + 0.5) AS BIGINT) AS of_all, CAST(floor(count(*) FILTER (WHERE status = 'pass') * 100 / count(*) + 0.5) AS BIGINT) AS of_started FROM latest GROUP BY 1",
)
def _(t):
    passed = F.size(F.filter(F.map_values("status"), lambda s: s == "pass"))
    size = F.size("status")
    return status_maps(t).select("submission", S.percent(passed, F.lit(21)).alias("of_all"), S.percent(passed, F.when(size > 0, size).otherwise(21)).alias("of_started"))


@query(
    "system_counts", "AG20",
    "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM nation) AS nations",
)
def _(t):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(t.customer, "customers")  # frames of one row each
    for df in (n(t.supplier, "suppliers"), t.orders.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")), n(t.nation, "nations")):
        one = one.crossJoin(df)
    return one


@query(
    "dashboard_counters", "AG21",
    f"WITH {V.POST_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'draft') AS drafts, count(*) FILTER (WHERE scheduled BETWEEN TIMESTAMP '1998-06-17' AND TIMESTAMP '1998-07-17') AS due_soon, count(*) FILTER (WHERE status = 'ready' AND scheduled < TIMESTAMP '1998-06-17') AS overdue FROM post",
)
def _(t):
    now, s = F.lit(datetime.datetime(1998, 6, 17)), F.col("scheduled")
    soon = s.between(now, F.lit(datetime.datetime(1998, 7, 17)))
    return V.posts(t).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if(soon).alias("due_soon"), F.count_if((F.col("status") == "ready") & (s < now)).alias("overdue"))


@query(
    "status_histogram", "AG22",
    f"WITH {V.POST_SQL}, s(status) AS (VALUES ('draft'), ('ready'), ('published'), ('archived')) SELECT s.status, count(post.id) AS n FROM s LEFT JOIN post ON post.status = s.status GROUP BY 1",
)
def _(t):
    kinds = t.frame([("draft",), ("ready",), ("published",), ("archived",)], "status string")
    counts = V.posts(t).groupBy("status").agg(F.count("*").alias("n"))
    return kinds.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("all_tags", "AG23", f"WITH {V.POST_SQL} SELECT DISTINCT unnest(tags) AS tag FROM post ORDER BY 1")
def _(t):
    return V.posts(t).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query("orders_per_customer", "AG24", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))  # before the join: a row per customer is shuffled
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "committee", "AG25",
    """WITH a AS (SELECT s_suppkey, s_nationkey, count(DISTINCT l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'lead' ELSE 'reader' END AS role, count(*) AS members, CAST(sum(n) AS BIGINT) AS assignments, CAST(max(n) AS BIGINT) AS most FROM a GROUP BY 1""",
)
def _(t):
    work = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("assigned"))
    members = t.supplier.join(work, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("n", F.coalesce("assigned", F.lit(0)).cast("long"))
    role = F.when(F.col("s_nationkey") % 2 == 0, "lead").otherwise("reader")
    return members.groupBy(role.alias("role")).agg(F.count("*").alias("members"), F.sum("n").alias("assignments"), F.max("n").alias("most"))


@query("count_where", "AG26", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 250000")
def _(t):
    return t.orders.where("o_totalprice > 250000").agg(F.count("*").alias("n"))


@query("completed_reviews", "AG27", "SELECT l_orderkey, count(*) AS reviews, count(*) FILTER (WHERE l_linestatus = 'F') AS completed FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("reviews"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))


@query(
    "comment_summary", "AG1 ST2",
    f"WITH {V.COMMENT_SQL} SELECT standard, spec, count(*) AS total, count(*) FILTER (WHERE unresolved) AS unresolved, count(*) FILTER (WHERE NOT unresolved) AS resolved FROM comment GROUP BY 1, 2 ORDER BY 1, 2",
)
def _(t):
    g = V.comments(t).groupBy("standard", "spec").agg(F.count("*").alias("total"), F.count_if("unresolved").alias("unresolved"), F.count_if(~F.col("unresolved")).alias("resolved"))
    return g.orderBy("standard", "spec")


@query(
    "comment_totals", "AG1",
    f"WITH {V.COMMENT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE unresolved) AS unresolved, arg_min(id, (ts, id)) AS first_id FROM comment",
)
def _(t):
    return V.comments(t).agg(F.count("*").alias("total"), F.count_if("unresolved").alias("unresolved"), F.min_by("id", F.struct("ts", "id")).alias("first_id"))


@query(
    "error_statistics", "AG2 AG3 FL5",
    f"""WITH {V.ERROR_SQL}, one AS (SELECT category, severity, fingerprint, count(*) AS occurrences FROM error WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1, 2, 3)
SELECT category, severity, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS distinct_errors FROM one GROUP BY GROUPING SETS ((category, severity), (category), (severity))""",
)
def _(t):
    """One scan for all three groupings."""
    recent = V.errors(t).where(F.col("ts") >= datetime.datetime(2024, 1, 8)).groupBy("category", "severity", "fingerprint").agg(F.count("*").alias("n"))
    sets = [[F.col("category"), F.col("severity")], [F.col("category")], [F.col("severity")]]
    return recent.groupingSets(sets, "category", "severity").agg(F.sum("n").alias("occurrences"), F.count("*").alias("distinct_errors"))


@query(
    "evidence_statistics", "AG4",
    f"WITH {V.EVIDENCE_SQL} SELECT kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN kind <> 'url' THEN size END), 0) AS BIGINT) AS size, count(*) FILTER (WHERE linked_label IS NOT NULL) AS linked, count(*) FILTER (WHERE linked_label IS NULL) AS unlinked FROM evidence GROUP BY 1",
)
def _(t):
    size = F.coalesce(F.sum(F.when(F.col("kind") != "url", F.col("size"))), F.lit(0)).cast("long")
    linked = F.col("linked_label").isNotNull()
    return V.evidence(t).groupBy("kind").agg(F.count("*").alias("n"), size.alias("size"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"))


@query(
    "ready_for_compilation", "AG6 JN1 JN7 FL9",
    """WITH r AS (SELECT l_orderkey, count(*) AS reviews, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT o_orderkey, reviews, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) AS compiled FROM orders JOIN r ON o_orderkey = l_orderkey WHERE reviews = done AND reviews > 0""",
)
def _(t):
    from ..operators.joins import exists_flag

    reviews = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("reviews"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    ready = t.orders.join(reviews, F.col("o_orderkey") == F.col("l_orderkey")).where((F.col("reviews") == F.col("done")) & (F.col("reviews") > 0))
    return exists_flag(ready, "o_orderkey", t.lineitem.where("l_discount > 0.09"), "l_orderkey", "compiled").select("o_orderkey", "reviews", "compiled")


@query(
    "comments_by_section", "AG28",
    f"WITH {V.COMMENT_SQL}, page AS (SELECT * FROM comment ORDER BY ts, id LIMIT 500) SELECT standard || '-' || spec AS section, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM page GROUP BY 1",
)
def _(t):
    first = V.comments(t).orderBy("ts", "id").limit(500)
    g = first.groupBy(F.concat_ws("-", "standard", "spec").alias("section")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return g.select("section", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    "next_sequence", "AG29",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(count(*) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(count(*) + 1 AS VARCHAR))) AS INTEGER), '0') AS next_id, CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS next_order FROM orders GROUP BY year(o_orderdate)""",
)
def _(t):
    n = (F.col("n") + 1).cast("string")
    g = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    return g.select(F.concat(F.col("y").cast("string"), F.lit("-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("next_id"), (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("next_order"))


@query("all_confirmed", "AG30", "SELECT o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) AS confirmed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_of_them"))
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("all_of_them", F.lit(True)).alias("confirmed"))


@query(
    "approval_state", "AG31",
    """WITH a AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS admin, CASE WHEN value > 60 THEN true WHEN value < 5 THEN false END AS lead FROM events)
SELECT event_id, CASE WHEN admin AND lead THEN 'approved' WHEN admin = false OR lead = false THEN 'denied' ELSE 'pending' END AS state FROM a""",
)
def _(t):
    admin = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    lead = F.when(F.col("value") > 60, True).when(F.col("value") < 5, False)
    yes, no = admin.eqNullSafe(True) & lead.eqNullSafe(True), admin.eqNullSafe(False) | lead.eqNullSafe(False)
    return t.events.select("event_id", F.when(yes, "approved").when(no, "denied").otherwise("pending").alias("state"))


@query(
    "import_counts", "AG32",
    f"WITH {V.LINE_SQL} SELECT doc, count(*) AS sections, count(*) FILTER (WHERE starts_with(line, 'Standard')) AS mapped, count(*) FILTER (WHERE NOT starts_with(line, 'Standard') AND n % 2 = 0) AS pending FROM text_line GROUP BY 1",
)
def _(t):
    mapped = F.col("line").startswith("Standard")
    return V.text_lines(t).groupBy("doc").agg(F.count("*").alias("sections"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped & (F.col("n") % 2 == 0)).alias("pending"))


@query(
    "bulk_determinations", "AG33",
    f"""WITH {COUNTS_SQL}, d AS (SELECT *, CASE WHEN spec % 7 = 0 THEN 'non_compliant' END AS final FROM agreed)
SELECT standard, spec, CASE WHEN final IS NULL AND consensus IS NOT NULL AND standard % 2 = 0 THEN consensus ELSE final END AS final, final IS NULL AND consensus IS NOT NULL AND standard % 2 = 0 AS changed FROM d""",
)
def _(t):
    d = C.consensus(V.votes(t), ["standard", "spec"]).withColumn("final", F.when(F.col("spec") % 7 == 0, "non_compliant"))
    change = F.col("final").isNull() & F.col("consensus").isNotNull() & (F.col("standard") % 2 == 0)
    return d.select("standard", "spec", F.when(change, F.col("consensus")).otherwise(F.col("final")).alias("final"), change.alias("changed"))


@query("outcomes", "AG34", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'compliant' ELSE 'non_compliant' END AS outcome FROM orders")
def _(t):
    recommendation = V.cases(F.col("o_orderstatus"), {"F": C.ACCREDITING[0], "O": C.ACCREDITING[1]}, "deny")
    return t.orders.select("o_orderkey", C.outcome(recommendation).alias("outcome"))


@query("vote_summary_text", "AG35 SK11", f"WITH {COUNTS_SQL} SELECT standard, spec, 'C: ' || n_compliant || ', NC: ' || n_non_compliant || ', N/A: ' || n_not_applicable AS summary FROM agreed")
def _(t):
    n = lambda v: F.col(f"n_{v}").cast("string")
    return C.vote_counts(V.votes(t), ["standard", "spec"]).select("standard", "spec", F.concat(F.lit("C: "), n("compliant"), F.lit(", NC: "), n("non_compliant"), F.lit(", N/A: "), n("not_applicable")).alias("summary"))
