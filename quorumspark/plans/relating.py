"""Joins, sorted pages and window-like computations as queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import catalogue as K
from ..operators import joins as J
from ..operators import latest as L
from ..operators import paging as P
from ..registry import query
from ..sources import views as V

#: Lines for each task in which the cells of a matrix meet their changes, about.
CELLS = 500_000


@query(
    "join_nested_children", "JN1",
    "SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS lines, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def _(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    joined = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))
    return joined.select("o_orderkey", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.size("lines").cast("long").alias("n"))


@query("join_lookup", "JN2", "SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(t):
    return J.lookup(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey", {"customer": "c_name", "segment": "c_mktsegment"}).select("o_orderkey", "customer", "segment")


@query(
    "join_lookup_array", "JN3",
    """WITH s AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS i FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
SELECT l_orderkey, coalesce(string_agg(s_name, ',' ORDER BY i) FILTER (WHERE s_name IS NOT NULL), '') AS readers FROM s LEFT JOIN supplier ON s.l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("ids"))
    found = J.lookup_array(rows, "ids", t.supplier.where("s_acctbal > 0"), "s_suppkey", "s_name", "names")
    return found.select("l_orderkey", F.array_join("names", ",").alias("readers"))


STANDARD_SQL = f"standards(code, part, title) AS (VALUES {', '.join(str(x) for x in K.STANDARDS)})"


@query("standards_by_code", "JN2", f"WITH {V.VALIDATION_SQL}, {STANDARD_SQL} SELECT id, v.standard, part, title FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'none' ELSE standard END AS standard FROM validation) v LEFT JOIN standards ON code = v.standard")
def _(t):
    """Validations with the part and title of their standard; each ninth names one that there is not."""
    coded = V.validations(t).select("id", F.when(F.col("id") % 9 == 0, "none").otherwise(F.col("standard")).alias("standard"))
    return J.with_standard(coded, "standard")


@query("standards_by_part", "JN2", f"WITH {V.VALIDATION_SQL}, {STANDARD_SQL} SELECT code, title, count(id) AS n FROM standards LEFT JOIN validation ON standard = code WHERE part = 'II' GROUP BY 1, 2")
def _(t):
    """The standards of the second part, with how many validations each has."""
    counts = J.of_part(V.validations(t), "standard", "II").groupBy("standard").agg(F.count("*").alias("n"))
    table = J.standards(t.spark).where("part = 'II'")
    return table.join(counts, F.col("code") == F.col("standard"), "left").select("code", "title", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "join_five_lookups", "JN4",
    """SELECT l_orderkey, l_linenumber, l_quantity, c_name, n_name, r_name, s_name, p_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40""",
)
def _(t):
    df = J.lookup(t.lineitem.where("l_quantity > 40"), "l_orderkey", t.orders, "o_orderkey", {"o_custkey": "o_custkey"})
    df = J.lookup(df, "o_custkey", t.customer, "c_custkey", {"c_name": "c_name", "c_nationkey": "c_nationkey"})
    df = J.lookup(df, "c_nationkey", t.nation, "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"})
    df = J.lookup(df, "n_regionkey", t.region, "r_regionkey", {"r_name": "r_name"})
    df = J.lookup(df, "l_suppkey", t.supplier, "s_suppkey", {"s_name": "s_name"})
    df = J.lookup(df, "l_partkey", t.part, "p_partkey", {"p_name": "p_name"})
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "c_name", "n_name", "r_name", "s_name", "p_name")


@query(
    "join_all_ids_valid", "JN5",
    "SELECT l_orderkey, count(*) AS given, count(s_suppkey) AS valid, count(*) = count(s_suppkey) AS all_valid FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 100 GROUP BY 1",
)
def _(t):
    given = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    flagged = J.exists_flag(given, "l_suppkey", t.supplier.where("s_acctbal > 100"), "s_suppkey", "ok")
    return flagged.groupBy("l_orderkey").agg(F.count("*").alias("given"), F.count_if("ok").alias("valid"), F.bool_and("ok").alias("all_valid"))


@query(
    "join_neither", "JN8",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
)
def _(t):
    mapped, unmapped = (t.lineitem.where(w).select(F.col("l_orderkey").alias("o_orderkey")) for w in ("l_returnflag = 'A'", "l_quantity > 40"))
    return t.orders.join(mapped.unionByName(unmapped), "o_orderkey", "left_anti").select("o_orderkey")


@query(
    "join_first_match", "JN9",
    "SELECT o_orderkey, min(l_linenumber) AS first_line, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS first_supplier FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.03 GROUP BY 1",
)
def _(t):
    found = t.lineitem.where("l_discount > 0.03").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("first"))
    first = F.col("first")
    joined = t.orders.join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", first["l_linenumber"].alias("first_line"), first["l_suppkey"].alias("first_supplier"))


@query(
    "matrix_import", "JN10 SK16",
    """WITH old AS (SELECT l_partkey AS standard, l_suppkey AS spec, max(l_linenumber) AS depth FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
new AS (SELECT l_partkey AS standard, l_suppkey AS spec, arg_max_null(CASE WHEN l_quantity > 10 THEN l_linenumber END, (l_orderkey, l_linenumber, l_quantity)) AS d FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(o.standard, n.standard) AS standard, coalesce(o.spec, n.spec) AS spec, CASE WHEN n.standard IS NOT NULL THEN n.d ELSE o.depth END AS depth FROM old o FULL JOIN new n ON o.standard = n.standard AND o.spec = n.spec) WHERE depth IS NOT NULL""",
)
def _(t):
    from ..operators.writes import nested_upsert

    line = t.lineitem.withColumnsRenamed({"l_partkey": "standard", "l_suppkey": "spec"})
    old = line.where("l_orderkey % 2 = 0").groupBy("standard", "spec").agg(F.max("l_linenumber").alias("depth"))
    new = line.where("l_orderkey % 2 = 1").select("standard", "spec", F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("depth"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("at"))
    # fewer than the session's, and Spark would deal both sides out again
    parts = max(t.lineitem.count() // CELLS + 1, int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return nested_upsert(old, new, ["standard", "spec"], "depth", "at", parts)


@query(
    "matrix_cells", "JN11",
    """SELECT s.s_suppkey, c.course, coalesce(max(l_quantity), 0) AS depth FROM supplier s CROSS JOIN (SELECT unnest(range(5)) AS course) c LEFT JOIN lineitem ON l_suppkey = s.s_suppkey AND l_linenumber % 5 = c.course GROUP BY 1, 2""",
)
def _(t):
    """Every cell of a matrix of specifications by five courses."""
    grid = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("course"))
    cells = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_linenumber") % 5).cast("long").alias("course")).agg(F.max("l_quantity").alias("depth"))
    return grid.join(cells, ["s_suppkey", "course"], "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))


@query(
    "join_fallback_chain", "JN13",
    """SELECT o_orderkey, coalesce(a.c_name, b.c_name, 'default') AS profile FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_acctbal > 5000
LEFT JOIN customer b ON b.c_custkey = o_custkey % 100 AND b.c_mktsegment = 'BUILDING'""",
)
def _(t):
    by_id = J.lookup(t.orders.withColumn("other", F.col("o_custkey") % 100), "o_custkey", t.customer.where("c_acctbal > 5000"), "c_custkey", {"a": "c_name"})
    by_name = J.lookup(by_id, "other", t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey", {"b": "c_name"})
    return by_name.select("o_orderkey", F.coalesce("a", "b", F.lit("default")).alias("profile"))


@query("join_by_name", "JN14", "SELECT a.p_partkey AS p_partkey, count(*) AS same_name FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) WHERE a.p_size = 7 GROUP BY 1")
def _(t):
    counts = t.part.groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("same_name"))
    return t.part.where("p_size = 7").join(counts, F.lower("p_name") == F.col("name")).select("p_partkey", "same_name")


@query("join_not_yet_there", "JN15", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("sort_mixed", "ST1", f"WITH {V.TENANT_SQL} SELECT c_custkey, tenant, c_acctbal FROM tenant ORDER BY tenant NULLS FIRST, c_acctbal DESC, c_custkey")
def _(t):
    return V.tenants(t).select("c_custkey", "tenant", "c_acctbal").orderBy(F.asc_nulls_first("tenant"), F.desc("c_acctbal"), "c_custkey")


@query("sort_codes", "ST2", f"WITH {V.VALIDATION_SQL} SELECT DISTINCT standard, rank() OVER (ORDER BY standard) AS as_text, rank() OVER (ORDER BY CAST(standard AS INTEGER)) AS as_number FROM (SELECT DISTINCT standard FROM validation)")
def _(t):
    codes = V.validations(t).select("standard").distinct()  # the 21 standards
    rank = lambda x: F.rank().over(Window.orderBy(x)).cast("long")
    return codes.select("standard", rank("standard").alias("as_text"), rank(F.col("standard").cast("int")).alias("as_number"))


@query("page_rows", "ST3", f"WITH {V.COMMENT_SQL} SELECT id, standard, spec FROM comment ORDER BY standard, spec, id LIMIT 20 OFFSET 40")
def _(t):
    return P.page(V.comments(t), 3, 20, F.asc("standard"), F.asc("spec"), F.asc("id")).select("id", "standard", "spec")


@query(
    "page_navigation", "ST3 ST4 ST5",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages, 3::BIGINT AS page, 60 < count(*) AS has_more, 1::BIGINT AS first_page, 2::BIGINT AS previous_page, least(4, CAST(ceil(count(*) / 20) AS BIGINT)) AS next_page, CAST(ceil(count(*) / 20) AS BIGINT) AS last_page FROM orders",
)
def _(t):
    return P.page_info(t.orders, 3, 20)


@query("page_numbers", "ST6", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 + 1 AS BIGINT) AS page FROM customer")
def _(t):
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return t.customer.select("c_custkey", (F.floor((n - 1) / 10) + 1).cast("long").alias("page"))


@query("top_recent_errors", "ST7", f"WITH {V.ERROR_SQL} SELECT id, category, severity FROM error WHERE category = 'error' ORDER BY ts DESC, id DESC LIMIT 50")
def _(t):
    return V.errors(t).where("category = 'error'").orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "category", "severity")


@query("last_of_list", "ST7", f"WITH {V.LINE_SQL} SELECT doc, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) AS last_five FROM text_line QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) <= 5".replace("FROM text_line QUALIFY", "FROM (SELECT * FROM text_line QUALIFY") + ") GROUP BY 1")
def _(t):
    last = L.newest(V.text_lines(t), ["doc"], 5, F.desc("n")).groupBy("doc").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    return last.select("doc", F.array_join(F.col("ns").cast("array<string>"), ",").alias("last_five"))


@query("newest_fifty", "ST8", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def _(t):
    return L.newest(t.events, ["user_id"], 50, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")


@query(
    "manual_order", "ST9",
    "SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 12 THEN 2 ELSE 3 END, n_nationkey) AS place FROM nation",
)
def _(t):
    given = t.frame([([7, 3, 12],)], "ids array<int>").select(F.posexplode("ids").alias("pos", "n_nationkey"))
    w = Window.orderBy(F.asc_nulls_last("pos"), "n_nationkey")  # a list of 25 that a user sorts by hand
    return t.nation.join(given, "n_nationkey", "left").select("n_nationkey", F.row_number().over(w).cast("long").alias("place"))


@query("sort_by_schedule", "ST10", f"WITH {V.POST_SQL} SELECT id, CAST(coalesce(epoch(scheduled), 0) AS BIGINT) AS due FROM post ORDER BY due, id")
def _(t):
    at = F.coalesce(F.unix_timestamp(F.col("scheduled").cast("timestamp")), F.lit(0)).cast("long")
    return V.posts(t).select("id", at.alias("due")).orderBy("due", "id")


@query(
    "running_page_numbers", "WN3 TX1",
    f"""WITH {V.LINE_SQL}, marked AS (SELECT *, CASE WHEN regexp_matches(trim(line), '^(?i)page\\s+[0-9]+') THEN CAST(regexp_extract(line, '([0-9]+)', 1) AS BIGINT) WHEN regexp_matches(trim(line), '^[0-9]+$') THEN CAST(trim(line) AS BIGINT) END AS marker FROM text_line WHERE trim(line) <> ''),
paged AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n), 1) AS page FROM marked) SELECT doc, n, trim(line) AS line, page FROM paged WHERE marker IS NULL""",
)
def _(t):
    from ..operators.text import sections

    return sections(V.text_lines(t)).select("doc", "n", "line", "page")


@query(
    "span_to_next", "WN6",
    "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS span FROM events WHERE event_type = 'signup'",
)
def _(t):
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.where("event_type = 'signup'").select("user_id", "event_id", (following - F.col("event_id")).alias("span"))


@query(
    "text_segments", "WN7",
    """WITH c AS (SELECT user_id, event_id, event_id % 97 AS s, event_id % 97 + event_id % 13 AS e FROM events WHERE event_type = 'error')
SELECT user_id, event_id, coalesce(lag(e) OVER w, 0) AS plain_from, s AS plain_to, coalesce(lag(e) OVER w, 0) < s AS has_plain, e AS marked_to FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""",
)
def _(t):
    c = t.events.where("event_type = 'error'").select("user_id", "event_id", (F.col("event_id") % 97).alias("s"), (F.col("event_id") % 97 + F.col("event_id") % 13).alias("e"))
    cursor = F.coalesce(F.lag("e").over(Window.partitionBy("user_id").orderBy("s", "event_id")), F.lit(0).cast("long"))
    return c.select("user_id", "event_id", cursor.alias("plain_from"), F.col("s").alias("plain_to"), (cursor < F.col("s")).alias("has_plain"), F.col("e").alias("marked_to"))


@query("reviewer_numbers", "WN8", "SELECT DISTINCT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("number"), F.count("*").over(w).alias("total"))


@query(
    "calendar_grid", "WN9 FL21",
    f"""WITH {V.POST_SQL}, days AS (SELECT CAST(unnest(range(TIMESTAMP '1998-05-31', TIMESTAMP '1998-07-05', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS day, month(day) = 6 AS in_month, count(id) AS posts FROM days LEFT JOIN post ON CAST(scheduled AS DATE) = day GROUP BY 1, 2""",
)
def _(t):
    """June 1998, padded to whole weeks from Sunday."""
    first, last = F.lit(datetime.date(1998, 6, 1)), F.lit(datetime.date(1998, 6, 30))
    days = t.frame([(1,)], "x int").select(F.explode(F.sequence(S.week_start(first), F.date_add(S.week_start(last), 6), F.expr("interval 1 day"))).alias("day"))
    counts = V.posts(t).groupBy(F.to_date("scheduled").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), (F.month("day") == 6).alias("in_month"), F.coalesce("n", F.lit(0)).cast("long").alias("posts"))


@query("debounced", "SM6", "SELECT event_id, user_id FROM events QUALIFY coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts > INTERVAL 2 HOUR, true)")
def _(t):
    from ..streaming.rules import debounced

    return debounced(t.events, "user_id", "ts", "event_id", "2 hours").select("event_id", "user_id")


@query(
    "sections_by_heading", "WN6 TX13",
    r"""WITH cut AS (SELECT page_id, string_split_regex(html, '(?i)<h1[^>]*>') AS p, regexp_extract_all(html, '(?i)<h1[^>]*>') AS h FROM pages),
bodies AS (SELECT page_id, list_concat(CASE WHEN len(h) = 0 OR length(p[1]) > 100 THEN [p[1]] ELSE [] END, list_transform(range(1, len(h) + 1), lambda i: h[i] || p[i + 1])) AS b FROM cut),
sections AS (SELECT page_id, unnest(range(0, len(b))) AS place, unnest(b) AS body FROM bodies)
SELECT page_id, CAST(place AS BIGINT) AS place, regexp_matches(body, '(?i)^<h1[^>]*>') AS has_heading,
  trim(regexp_replace(regexp_extract(body, '(?i)^<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS heading, body FROM sections""",
)
def _(t):
    """A row for each section of each page, with its text."""
    from ..operators.text import html_sections

    cut = t.pages.select("page_id", F.posexplode(html_sections(F.col("html"))).alias("place", "s"))
    return cut.select("page_id", F.col("place").cast("long").alias("place"), "s.has_heading", "s.heading", "s.body")
