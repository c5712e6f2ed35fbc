"""Document text as queries, over the derived text lines, pages and HTML made from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..operators import text as X
from ..registry import query
from ..sources import views as V


@query(
    "section_kinds", "TX1 TX2 TX3",
    f"""WITH {V.LINE_SQL}, l AS (SELECT doc, n, trim(line) AS line FROM text_line WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(?i)page\\s+[0-9]+') AND NOT regexp_matches(trim(line), '^[0-9]+$'))
SELECT doc, n, CASE WHEN regexp_matches(line, '^(Standard\\s*[0-9]|Section\\s*[IVX]+|Part\\s*[IVX]+|Chapter\\s*[0-9])', 'i') THEN 'heading' WHEN regexp_matches(line, '^[-*]\\s|^[0-9]+[.)]\\s') THEN 'list'
 WHEN len(string_split(line, chr(9))) > 2 THEN 'table' ELSE 'paragraph' END AS kind, regexp_matches(line, '^[A-Z\\s]+$') OR (length(line) < 50 AND regexp_matches(line, '^[A-Z]')) AS bold FROM l""",
)
def _(t):
    return X.sections(V.text_lines(t)).select("doc", "n", "kind", "bold")


@query(
    "standard_references", "TX4",
    f"""WITH {V.LINE_SQL}, r AS (
SELECT doc, n, 0 AS pattern, unnest(regexp_extract_all(line, '(?i)standard\\s*([0-9]{{1,2}})([a-z])?', 1)) AS standard, nullif(lower(unnest(regexp_extract_all(line, '(?i)standard\\s*([0-9]{{1,2}})([a-z])?', 2))), '') AS spec, 95 AS confidence FROM text_line
UNION ALL SELECT doc, n, 1, unnest(regexp_extract_all(line, '\\b([0-9]{{1,2}})\\.([a-z])\\b', 1)), unnest(regexp_extract_all(line, '\\b([0-9]{{1,2}})\\.([a-z])\\b', 2)), 80 FROM text_line
UNION ALL SELECT doc, n, 4, '21', NULL, 60 FROM (SELECT doc, n, unnest(regexp_extract_all(line, '(?i)field\\s*(experience|placement)')) FROM text_line)
UNION ALL SELECT doc, n, 5, '6', NULL, 60 FROM (SELECT doc, n, unnest(regexp_extract_all(line, '(?i)faculty\\s*credentials?')) FROM text_line))
SELECT doc, n, CAST(pattern AS INTEGER) AS pattern, standard, spec, CAST(confidence AS INTEGER) AS confidence FROM r""",
)
def _(t):
    return X.references(V.text_lines(t)).select("doc", "n", "pattern", "standard", "spec", "confidence")


@query(
    "text_tables", "TX5 TX6 WN4",
    f"""WITH {V.LINE_SQL}, m AS (SELECT *, len(string_split(line, chr(9))) > 2 AS is_row, sum(CASE WHEN len(string_split(line, chr(9))) > 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n) AS island FROM text_line),
g AS (SELECT doc, island, min(n) AS first_line, count(*) AS n_rows, arg_min(line, n) AS headers, string_agg(line, ' ' ORDER BY n) AS body FROM m WHERE is_row GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc, first_line, n_rows - 1 AS n_rows, replace(headers, chr(9), '|') AS headers,
  CASE WHEN CAST(regexp_matches(body, 'course', 'i') AS INT) + CAST(regexp_matches(body, 'standard', 'i') AS INT) + CAST(regexp_matches(body, '[ITKS]') AS INT) + CAST(regexp_matches(body, '[LMH]') AS INT) + CAST(regexp_matches(body, 'CHS\\s*[0-9]+', 'i') AS INT) >= 2 THEN 'curriculum_matrix'
  WHEN CAST(regexp_matches(body, 'grade', 'i') AS INT) + CAST(regexp_matches(body, 'percentage', 'i') AS INT) + CAST(regexp_matches(body, 'QPA|GPA', 'i') AS INT) + CAST(regexp_matches(body, '[A-F]') AS INT) >= 2 THEN 'grading_scale'
  WHEN CAST(regexp_matches(body, 'week', 'i') AS INT) + CAST(regexp_matches(body, 'date', 'i') AS INT) + CAST(regexp_matches(body, 'topic', 'i') AS INT) + CAST(regexp_matches(body, 'assignment', 'i') AS INT) + CAST(regexp_matches(body, 'reading', 'i') AS INT) >= 2 THEN 'schedule'
  WHEN CAST(regexp_matches(body, 'course', 'i') AS INT) + CAST(regexp_matches(body, 'credit', 'i') AS INT) + CAST(regexp_matches(body, 'semester', 'i') AS INT) + CAST(regexp_matches(body, 'prerequisite', 'i') AS INT) >= 2 THEN 'course_list' ELSE 'unknown' END AS table_type FROM g""",
)
def _(t):
    return X.tables(V.text_lines(t)).select("doc", "first_line", F.size("rows").cast("long").alias("n_rows"), F.array_join("headers", "|").alias("headers"), "table_type")


def order_html(t):
    """o_orderkey, html: a paragraph, a table of the order's lines in one of two spellings, for each third order one of its
    dates, and for each fifth, before these, one of a single row."""
    c = F.col
    cell = lambda tag, *xs: F.concat(F.lit(f"<{tag}>"), *xs, F.lit(f"</{tag.split()[0]}>"))
    row = F.concat(F.lit("<tr>"), cell("td", "l_returnflag"), cell("td align='right'", F.lit(" "), c("l_quantity").cast("int").cast("string"), F.lit("<b>+</b> ")), F.lit("</tr>"))
    lines = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["row"]), "\n")
    grades = F.concat(F.lit("<table class='a'><thead><tr><th>Grade</th><th>Percentage</th></tr></thead>"), body, F.lit("</table>"))
    dates = F.concat(F.lit("<TABLE><TR><td>week</td></TR><tr><td>topic &amp; date "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td></tr><tr></tr></TABLE>"))
    single = F.lit("<table><tr><td>single</td></tr></table>")
    k = c("o_orderkey")
    html = F.concat(F.lit("<p>x</p>"), F.when(k % 5 == 0, single).otherwise(""), grades, F.when(k % 3 == 0, dates).otherwise("<p>end</p>"))
    return lines.join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", html.alias("html"))


@query(
    "html_tables", "TX7",
    """SELECT l_orderkey AS o_orderkey, 0 AS place, count(*) + 1 AS n_rows, 'Grade|Percentage' AS headers, arg_min(l_returnflag || '|' || CAST(l_quantity AS INTEGER) || '+', (l_linenumber, l_returnflag, l_quantity)) AS first_row, 'grading_scale' AS table_type FROM lineitem GROUP BY 1
UNION ALL SELECT o_orderkey, 1, 2, 'week', 'topic &amp; date ' || strftime(o_orderdate, '%Y-%m-%d'), 'schedule' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def _(t):
    """Tables of two rows or more; the oracle knows the rows that went in."""
    df = order_html(t).select("o_orderkey", F.posexplode(X.html_tables(F.col("html"))).alias("place", "rows"))
    join = lambda i: F.array_join(F.get("rows", F.lit(i)), "|")
    kind = X.table_type(F.array_join(F.flatten("rows"), " "))
    return df.select("o_orderkey", "place", F.size("rows").cast("long").alias("n_rows"), join(0).alias("headers"), join(1).alias("first_row"), kind.alias("table_type"))


@query("page_estimate", "TX8", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 3000.0) AS BIGINT)) AS pages, CAST(len(string_split_regex(text, '\\n{3,}')) AS BIGINT) AS slides FROM documents")
def _(t):
    return t.documents.select("doc_id", X.pages_estimate(F.col("text")).alias("pages"), F.size(F.split("text", r"\n{3,}")).cast("long").alias("slides"))


@query(
    "matrix_cells_parsed", "TX9",
    """WITH c AS (SELECT DISTINCT substr('ITKS', CAST(l_linenumber % 4 + 1 AS INTEGER), CAST(l_suppkey % 3 AS INTEGER)) || '/' || substr('LMH', CAST(l_linenumber % 3 + 1 AS INTEGER), CAST(l_suppkey % 2 + 1 AS INTEGER)) AS cell FROM lineitem)
SELECT cell, CASE WHEN contains(cell, 'I') THEN 'I' ELSE '' END || CASE WHEN contains(cell, 'T') THEN 'T' ELSE '' END || CASE WHEN contains(cell, 'K') THEN 'K' ELSE '' END || CASE WHEN contains(cell, 'S') THEN 'S' ELSE '' END AS types,
  CASE WHEN contains(cell, 'H') THEN 'H' WHEN contains(cell, 'M') THEN 'M' WHEN contains(cell, 'L') THEN 'L' END AS depth FROM c""",
)
def _(t):
    part = lambda s, a, n: F.substring(F.lit(s), a.cast("int"), n.cast("int"))
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    cell = F.concat(part("ITKS", line % 4 + 1, supp % 3), F.lit("/"), part("LMH", line % 3 + 1, supp % 2 + 1))
    return t.lineitem.select(cell.alias("cell")).distinct().select("cell", X.matrix_cell(F.col("cell")).alias("m")).select("cell", "m.types", "m.depth")


#: Lines for the heading levels that the derived text does not reach, with their levels worked out by hand.
HEADINGS = [
    ("STANDARD 3 FACULTY", 1), ("Part IV", 1), ("PROGRAM OVERVIEW: 2024", 1), ("2.1 Overview of aims", 2), ("12 Months", 2), ("a. first part", 3), ("(b) second part", 3),
    ("Specification C", 3), ("iv. roman", 4), ("ii) roman", 4), ("Mission Statement:", 2), ("Summary", 2), ("Random Words", 0), ("plain text of a paragraph", 0), ("i. one", 3), ("SHORT", 0),
]


@query(
    "header_levels", "TX10",
    f"""WITH {V.LINE_SQL} SELECT trim(line) AS line, CASE WHEN regexp_matches(line, '^(standard|part|chapter|section)\\s+[ivxlcdm0-9]+', 'i') THEN 1 ELSE 0 END AS level, count(*) AS n FROM text_line GROUP BY 1, 2
UNION ALL SELECT line, level, 1 FROM (VALUES {", ".join(str(x) for x in HEADINGS)}) AS v(line, level)""",
)
def _(t):
    lines = V.text_lines(t).select(F.trim("line").alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    more = t.frame([x[:1] for x in HEADINGS], "line string").withColumn("n", F.lit(1).cast("long"))
    return lines.unionByName(more).select("line", X.header_level(F.col("line")).alias("level"), "n")


@query("text_to_html", "TX11 WN5", None)
def _(t):
    """Blocks and lists need ordered runs; held against a re-statement in the tests."""
    return X.to_html(V.text_lines(t))


@query(
    "promoted_headings", "TX12",
    """WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'STANDARD ' || user_id || ': GOALS' WHEN 1 THEN '2.1 Aims of ' || event_type WHEN 2 THEN 'some text on ' || event_type ELSE 'iv. ' || event_type END AS line,
  CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 3 THEN '4' END AS level FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '<h2>kept</h2><p>' || line || '</p>' WHEN level IS NULL THEN '<div>x</div><p>' || line || '</p><p>plain words only</p>' ELSE '<div>x</div><h' || level || '>' || line || '</h' || level || '><p>plain words only</p>' END AS html FROM l""",
)
def _(t):
    """A paragraph for each event, in documents of which each seventh has a heading already."""
    c = F.col
    k = c("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("STANDARD "), c("user_id").cast("string"), F.lit(": GOALS"))).when(k == 1, F.concat(F.lit("2.1 Aims of "), "event_type")).when(k == 2, F.concat(F.lit("some text on "), "event_type")).otherwise(F.concat(F.lit("iv. "), "event_type"))
    paragraph = F.concat(F.lit("<p>"), line, F.lit("</p>"))
    html = F.when(c("event_id") % 7 == 0, F.concat(F.lit("<h2>kept</h2>"), paragraph)).otherwise(F.concat(F.lit("<div>x</div>"), paragraph, F.lit("<p>plain words only</p>")))
    return t.events.select("event_id", html.alias("html")).select("event_id", X.promoted(c("html")).alias("html"))


SCORE_SQL = f"""{V.LINE_SQL}, one AS (SELECT DISTINCT line FROM text_line), kw(standard, spec, keyword, points, place) AS (VALUES {K.keyword_rows()}),
k AS (SELECT line, standard, sum(points) AS score, arg_max(spec, place) FILTER (WHERE spec IS NOT NULL) AS spec FROM one JOIN kw ON contains(lower(line), keyword) GROUP BY 1, 2),
refs AS (SELECT line, regexp_extract(line, '(?i)standard\\s*([0-9]{{1,2}})', 1) AS standard, nullif(lower(regexp_extract(line, '(?i)standard\\s*[0-9]{{1,2}}([a-z])', 1)), '') AS spec, 95 AS c, 0 AS p FROM one WHERE regexp_matches(line, '(?i)standard\\s*[0-9]')
  UNION ALL SELECT line, regexp_extract(line, '\\b([0-9]{{1,2}})\\.[a-z]\\b', 1), regexp_extract(line, '\\b[0-9]{{1,2}}\\.([a-z])\\b', 1), 80, 1 FROM one WHERE regexp_matches(line, '\\b[0-9]{{1,2}}\\.[a-z]\\b')
  UNION ALL SELECT line, '21', NULL, 60, 4 FROM one WHERE regexp_matches(line, '(?i)field\\s*(experience|placement)')
  UNION ALL SELECT line, '6', NULL, 60, 5 FROM one WHERE regexp_matches(line, '(?i)faculty\\s*credentials?')),
r AS (SELECT line, standard, sum(c) AS score, arg_min(spec, p) FILTER (WHERE spec IS NOT NULL) AS spec, min(p) AS p FROM refs GROUP BY 1, 2),
score AS (SELECT coalesce(k.line, r.line) AS line, coalesce(k.standard, r.standard) AS standard, coalesce(k.score, 0) + coalesce(r.score, 0) AS score, coalesce(k.spec, r.spec) AS spec, r.p FROM k FULL JOIN r ON k.line = r.line AND k.standard = r.standard),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY p NULLS LAST, CAST(standard AS INTEGER)) AS rank FROM score)"""


@query("keyword_scores", "TX14", f"WITH {SCORE_SQL} SELECT line, standard, CAST(score AS BIGINT) AS score, spec, CAST(rank AS BIGINT) AS rank FROM ranked")
def _(t):
    scores = X.keyword_scores(V.text_lines(t).select("line").distinct(), ["line"])
    return scores.select("line", "standard", "score", "spec", F.col("rank").cast("long").alias("rank"))


@query(
    "best_standards", "TX15 TX20",
    f"""WITH {SCORE_SQL}, best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, rank) = 1)
SELECT doc, n, b.standard, CASE WHEN b.line IS NOT NULL THEN coalesce(spec, 'a') END AS spec, CASE WHEN score IS NOT NULL THEN CAST(least(score, 95) AS BIGINT) END AS confidence,
  CASE WHEN b.line IS NULL THEN 'unmapped: no match' WHEN score >= 60 THEN 'mapped' ELSE 'unmapped: low confidence' END AS route FROM text_line t LEFT JOIN best b ON t.line = b.line AND score >= 20""",
)
def _(t):
    c = F.col("confidence").cast("long")
    route = F.when(c.isNull(), "unmapped: no match").when(c >= 60, "mapped").otherwise("unmapped: low confidence")
    return X.best_matches(V.text_lines(t)).select("doc", "n", "standard", "spec", c.alias("confidence"), route.alias("route"))


@query("alternative_standards", "TX16", None)
def _(t):
    """Displaced bests depend on the order of iteration; held against a re-statement in the tests."""
    shown = F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["standard"], a["spec"], a["confidence"].cast("string"))), ",")
    best = X.best_matches(V.text_lines(t).select("line").distinct()).where("standard is not null")
    return best.select("line", "standard", shown.alias("alternatives"))


@query(
    "content_types", "TX17",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'syllabus' WHEN p_partkey % 5 = 1 THEN 'cv' WHEN p_partkey % 5 = 2 THEN 'evaluation_form' WHEN p_partkey % 5 = 3 THEN 'matrix' END AS content_type FROM part""",
)
def _(t):
    texts = ["Course Objectives and grading policy of {}", "EDUCATION and Publications: {}", "Evaluation with a rating scale ({})", "Curriculum matrix {}: T, M", "only an evaluation of {}"]
    k, text = F.col("p_partkey") % 5, None
    for i, x in enumerate(texts):
        before, after = x.split("{}")
        made = F.concat(F.lit(before), F.col("p_name"), F.lit(after))
        text = F.when(k == i, made) if text is None else text.when(k == i, made)
    return t.part.select("p_partkey", X.content_type(text).alias("content_type"))


@query(
    "table_mappings", "TX18",
    f"""WITH {V.LINE_SQL}, m AS (SELECT *, sum(CASE WHEN len(string_split(line, chr(9))) > 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n) AS island FROM text_line),
g AS (SELECT doc, min(n) AS first_line, lower(string_agg(line, ' ' ORDER BY n)) AS body FROM m WHERE len(string_split(line, chr(9))) > 2 GROUP BY doc, island HAVING count(*) > 1)
SELECT doc, first_line, CASE WHEN contains(body, 'course') THEN '11' END AS standard, CASE WHEN contains(body, 'course') THEN 'matrix' END AS spec, CASE WHEN contains(body, 'course') THEN 90 END AS confidence FROM g""",
)
def _(t):
    text = F.concat_ws(" ", F.array_join("headers", " "), F.array_join(F.flatten("rows"), " "))
    mapped = X.tables(V.text_lines(t)).withColumn("m", X.table_mapping(F.col("table_type"), text))
    return mapped.select("doc", "first_line", "m.standard", "m.spec", "m.confidence")


@query(
    "match_confidence", "TX19",
    "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE least(95.0, 2 * 100.0 / (p_size % 7) + CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 0 END) END::DOUBLE AS confidence FROM part",
)
def _(t):
    matched = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Standard 4"), F.col("p_name"))).otherwise(F.array(F.lit("goals"), F.col("p_name")))
    return t.part.select("p_partkey", X.match_confidence(matched, F.col("p_size") % 7).alias("confidence"))


@query(
    "applied_mappings", "TX21",
    f"""WITH {SCORE_SQL}, best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, rank) = 1)
SELECT doc, b.standard, coalesce(b.spec, 'a') AS spec, string_agg(t.line, chr(10) || chr(10) ORDER BY n) AS narrative FROM text_line t JOIN best b ON t.line = b.line AND score >= 60 GROUP BY 1, 2, 3""",
)
def _(t):
    g = X.best_matches(V.text_lines(t)).where("confidence >= 60").groupBy("doc", "standard", "spec").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("xs"))
    return g.select("doc", "standard", "spec", F.array_join(F.transform("xs", lambda x: x["line"]), "\n\n").alias("narrative"))


@query("leftover_sections", "TX20 JN8", f"WITH {V.LINE_SQL} SELECT doc, n FROM text_line WHERE NOT starts_with(line, 'Standard') AND NOT starts_with(line, '3.b')")
def _(t):
    lines = V.text_lines(t)
    mapped = lines.where(F.col("line").startswith("Standard")).select("doc", "n")
    unmapped = lines.where(F.col("line").startswith("3.b")).select("doc", "n")
    return lines.select("doc", "n").join(mapped.unionByName(unmapped), ["doc", "n"], "left_anti")
