"""Document text: sections, references, tables, headings and keyword scores."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import first_kind, hits, trimmed
from . import catalogue
from .payload import let


def sections(lines: DataFrame) -> DataFrame:
    """doc, n, line to doc, n, line, page, kind, bold: blank lines and page markers go; a marker's number holds for
    the lines after it (1 before any)."""
    line = trimmed(F.col("line"))
    marker = F.when(line.rlike(catalogue.PAGE_MARKER), F.regexp_extract(line, r"(\d+)", 1)).when(line.rlike(catalogue.PAGE_NUMBER), line).cast("long")
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.where(line != "").withColumns({"line": line, "__marker": marker})
    paged = marked.withColumn("page", F.coalesce(F.last("__marker", ignorenulls=True).over(w), F.lit(1)).cast("long")).where("__marker is null").drop("__marker")
    return paged.withColumns({"kind": section_kind(F.col("line")), "bold": bold(F.col("line"))})


def section_kind(line: Column) -> Column:
    return F.when(line.rlike(catalogue.SECTION_HEADING), "heading").when(line.rlike(catalogue.LIST_ITEM), "list").when(F.size(F.split(line, "\t")) > 2, "table").otherwise("paragraph")


def bold(line: Column) -> Column:
    return line.rlike(catalogue.CAPITALS) | ((F.length(line) < catalogue.BOLD_LENGTH) & line.rlike(catalogue.CAPITAL))


def references_in(text: Column) -> Column:
    """The standard references of a text, in order of pattern and then of occurrence: pattern, occurrence, matched, standard,
    spec, confidence (hundredths)."""
    found = []
    for i, (pattern, kind, standard) in enumerate(catalogue.REFERENCES):
        if kind not in ("explicit", "numeric") and not standard:
            continue
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.transform(every, _reference(i, pattern, {"explicit": 95, "numeric": 80}.get(kind, 60), standard)))
    return F.concat(*found)


def references(df: DataFrame, text: str = "line") -> DataFrame:
    """A row per standard reference in the text."""
    return df.withColumn("__r", F.explode(references_in(F.col(text)))).select("*", "__r.*").drop("__r")


def _reference(place: int, pattern: str, confidence: int, standard: str | None):
    """What a match of the pattern tells: its groups, or a fixed standard."""

    def make(matched: Column, occurrence: Column) -> Column:
        spec = F.lit(None).cast("string") if standard else F.nullif(F.lower(F.regexp_extract(matched, pattern, 2)), F.lit(""))
        code = F.lit(standard) if standard else F.regexp_extract(matched, pattern, 1)
        return F.struct(F.lit(place).alias("pattern"), occurrence.alias("occurrence"), matched.alias("matched"), code.alias("standard"), spec.alias("spec"), F.lit(confidence).alias("confidence"))

    return make


def tables(lines: DataFrame) -> DataFrame:
    """doc, table, first_line, rows, headers, table_type: runs of two lines or more with two tabs or more each."""
    is_row = F.size(F.split("line", "\t")) > 2
    w = Window.partitionBy("doc").orderBy("n")
    broken = lines.withColumn("__row", is_row).withColumn("__island", F.sum((~F.col("__row")).cast("int")).over(w)).where("__row")
    g = broken.groupBy("doc", "__island").agg(F.min("n").alias("first_line"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows")).where(F.size("rows") > 1)
    cells = F.transform("rows", lambda r: F.transform(F.split(r["line"], "\t"), trimmed))
    return g.withColumn("rows", cells).select("doc", "first_line", F.get("rows", F.lit(0)).alias("headers"), F.slice("rows", F.lit(2), F.size("rows")).alias("rows"), table_type(F.array_join(F.flatten("rows"), " ")).alias("table_type"))


def table_type(text: Column) -> Column:
    return first_kind(text, catalogue.TABLE_TYPES, 2, "unknown")


def content_type(text: Column) -> Column:
    return first_kind(text, catalogue.CONTENT_TYPES, 2, None)


def html_tables(html: Column) -> Column:
    """Tables of two rows or more as arrays of rows of cell texts."""
    every = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    cells = lambda row: F.transform(every(row, catalogue.CELL), lambda c: trimmed(F.regexp_replace(c, catalogue.TAG, "")))
    rows = lambda table: F.filter(F.transform(every(table, catalogue.ROW), cells), lambda r: F.size(r) > 0)
    return F.filter(F.transform(every(html, catalogue.TABLE), rows), lambda t: F.size(t) >= 2)


def html_sections(html: Column, least: int = 100) -> Column:
    """An array of (has_heading, heading, body): the text from each h1 to the next; what precedes the first is kept
    if it is longer than least, and a text without any h1 is one section."""
    parts = F.split(html, catalogue.SECTION_START)
    one = lambda p: F.struct(
        p.rlike("(?i)^<h1[^>]*>").alias("has_heading"),
        trimmed(F.regexp_replace(F.regexp_extract(p, catalogue.SECTION_TITLE, 1), catalogue.TAG, "")).alias("heading"),
        p.alias("body"),
    )
    made = F.transform(parts, one)
    kept = F.filter(made, lambda s: s["has_heading"] | (F.length(s["body"]) > least))
    return F.when(F.exists(made, lambda s: s["has_heading"]), kept).otherwise(made)


def header_level(line: Column) -> Column:
    """1 to 4 for lines that look like headings, else 0."""
    out = None
    titled = line.rlike(catalogue.TITLED) & line.rlike(catalogue.HEADING_WORDS)
    tests = [(line.rlike(pattern), level, below) for pattern, level, below in catalogue.HEADINGS]
    for test, level, below in [*tests, (titled, catalogue.TITLED_LEVEL, catalogue.TITLED_LENGTH)]:
        test = test & (F.length(line) < below) if below else test
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(0)


def escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def item_text(line: Column) -> Column:
    for mark in catalogue.ITEM_MARKS:
        line = F.regexp_replace(line, mark, "")
    return line


def to_html(lines: DataFrame) -> DataFrame:
    """doc, html: headings, lists (items with at most blank lines between them in one) and paragraphs (neighbouring
    lines in one)."""
    line = trimmed(F.col("line"))
    level = header_level(line)
    kind = F.when(line == "", "blank").when(level > 0, "header").when(line.rlike(catalogue.LIST_ITEM), "item").otherwise("text")
    w = Window.partitionBy("doc").orderBy("n")
    marked = lines.select("doc", "n", line.alias("line"), kind.alias("kind"), level.alias("level")).withColumn("after_blank", F.lag("kind").over(w).eqNullSafe("blank")).where("kind <> 'blank'")
    begins = (F.col("kind") == "header") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | ((F.col("kind") == "text") & F.col("after_blank"))
    runs = marked.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w))
    shown = F.when(F.col("kind") == "item", F.concat(F.lit("<li>"), escaped(item_text(F.col("line"))), F.lit("</li>"))).otherwise(escaped(F.col("line")))
    g = runs.groupBy("doc", "run", "kind").agg(F.min("n").alias("n"), F.min("level").alias("level"), F.array_sort(F.collect_list(F.struct("n", shown.alias("x")))).alias("xs"))
    xs = F.transform("xs", lambda x: x["x"])
    tag = F.concat(F.lit("h"), F.col("level").cast("string"), F.lit(">"))
    block = (
        F.when(F.col("kind") == "header", F.concat(F.lit("<"), tag, F.array_join(xs, " "), F.lit("</"), tag))
        .when(F.col("kind") == "item", F.concat(F.lit("<ul>\n"), F.array_join(xs, "\n"), F.lit("\n</ul>")))
        .otherwise(F.concat(F.lit("<p>"), F.array_join(xs, " "), F.lit("</p>")))
    )
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n")
    # a list at the very end is closed before its line end
    return g.groupBy("doc").agg(html.alias("html")).withColumn("html", F.regexp_replace("html", r"\n</ul>\z", "</ul>\n"))


def promoted(html: Column) -> Column:
    """Paragraphs that look like headings become headings, where there is no heading yet."""
    pieces = F.split(html, r"(?=<p>)|(?<=</p>)")

    def one(p: Column) -> Column:
        content = F.regexp_extract(p, r"(?s)^<p>([^<]+)</p>\z", 1)
        level = header_level(trimmed(content)).cast("string")
        return F.when((content != "") & (level != "0"), F.concat(F.lit("<h"), level, F.lit(">"), content, F.lit("</h"), level, F.lit(">"))).otherwise(p)

    return F.when(html.rlike("(?i)<h[1-6]"), html).otherwise(F.array_join(F.transform(pieces, one), ""))


def matrix_cell(value: Column) -> Column:
    """types (of I, T, K, S, joined) and depth (the highest of H, M, L) of a matrix cell."""
    v = F.upper(value)
    types = F.concat(*(F.when(v.contains(x), x).otherwise("") for x in "ITKS"))
    depth = F.when(v.contains("H"), "H").when(v.contains("M"), "M").when(v.contains("L"), "L")
    return F.struct(types.alias("types"), depth.alias("depth"))


def pages_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3000)).cast("long")


SCORE = "struct<standard: string, score: bigint, spec: string, rank: int>"


def _trie(words: list[str]) -> str:
    """A pattern of the words that goes through a text letter by letter and takes the longest."""
    heads: dict[str, list[str]] = {}
    for w in filter(None, words):
        heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    one = "|".join(re.escape(c) + _trie(rest) for c, rest in heads.items())
    return f"(?:{one})" + ("?" if "" in words else "")


@functools.cache
def _keyword_rows() -> tuple[str, str, str]:
    """The catalogue as JSON, a pattern of the longest keyword at each place, and as JSON where in the catalogue it and all
    keywords that it begins with are: together these are all keywords that the text holds."""
    rows = list(catalogue.keywords())
    within = {k: [i for i, (_, _, w, _) in enumerate(rows) if k.startswith(w)] for _, _, k, _ in rows}
    return json.dumps([{"standard": s, "spec": p, "points": n} for s, p, _, n in rows]), f"(?=({_trie(sorted(within))}))", json.dumps(within)


def _keyword_constants() -> tuple[Column, str, Column]:
    terms, longest, within = _keyword_rows()
    return F.from_json(F.lit(terms), "array<struct<standard: string, spec: string, points: int>>"), longest, F.from_json(F.lit(within), "map<string, array<int>>")


def scores_in(text: Column) -> Column:
    """The standards that a text tells of, as an array of SCORE: 30 for each keyword of a standard, 20 for each of its
    specifications, plus the confidences of explicit references (hundredths); the last matching specification counts. In
    order of the first reference, then of the standard's number; rank is the place from 1. Empty for null."""
    text = F.coalesce(text, F.lit(""))
    terms, longest, within = _keyword_constants()
    hit = F.regexp_extract_all(F.lower(text), F.lit(longest), F.lit(1))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(hit), lambda h: F.try_element_at(within, h)))))
    found = F.transform(places, lambda i: F.get(terms, i))

    def scored(both: Column) -> Column:
        k, r = both["k"], both["r"]
        numbers = F.array_sort(F.transform(F.array_distinct(F.transform(k, lambda x: x["standard"])), lambda x: x.cast("int")))
        order = F.array_distinct(F.concat(F.transform(r, lambda x: x["standard"]), F.transform(numbers, lambda x: x.cast("string"))))

        def one(standard: Column, i: Column) -> Column:
            of = lambda xs: F.filter(xs, lambda x: x["standard"] == standard)
            total = lambda xs, field: F.aggregate(of(xs), F.lit(0).cast("long"), lambda n, x: n + x[field])
            last = lambda xs: F.try_element_at(F.filter(of(xs), lambda x: x["spec"].isNotNull()), F.lit(-1))["spec"]
            score = total(k, "points") + total(r, "confidence")
            return F.struct(standard.alias("standard"), score.alias("score"), F.coalesce(last(k), last(r)).alias("spec"), (i + 1).alias("rank"))

        return F.transform(order, one)

    return let(F.struct(found.alias("k"), references_in(text).alias("r")), scored)


def keyword_scores(df: DataFrame, key: list[str], text: str = "line") -> DataFrame:
    """key, standard, score, spec, rank: a row for each standard that the text tells of."""
    return df.select(*key, F.inline(scores_in(F.col(text))))


def best_of(scores: Column) -> Column:
    """standard, spec, confidence, alternatives of scores_in(): the highest score (the first in rank among equals) from 20
    up, else null; alternatives are bests that a later one displaced, and others above 20, the first three as they come."""
    start = F.struct(F.lit(None).cast(SCORE).alias("best"), F.array().cast(f"array<{SCORE}>").alias("others"))

    def step(s: Column, x: Column) -> Column:
        state = lambda best, others: F.struct(best.alias("best"), others.alias("others"))
        return (
            F.when(s["best"].isNull(), state(x, s["others"]))
            .when(x["score"] > s["best"]["score"], state(x, F.array_append(s["others"], s["best"])))
            .when(x["score"] > 20, state(s["best"], F.array_append(s["others"], x)))
            .otherwise(s)
        )

    def finish(s: Column) -> Column:
        shown = lambda x: (x["standard"].alias("standard"), F.coalesce(x["spec"], F.lit("a")).alias("spec"), F.least(x["score"], F.lit(95)).alias("confidence"))
        others = F.transform(F.slice(s["others"], 1, 3), lambda x: F.struct(*shown(x)))
        return F.when(s["best"]["score"] >= 20, F.struct(*shown(s["best"]), others.alias("alternatives")))

    return F.aggregate(scores, start, step, finish)


def best_matches(df: DataFrame, text: str = "line") -> DataFrame:
    """df with standard, spec, confidence and alternatives of the text: see best_of(); null where nothing reaches 20."""
    return df.select("*", F.inline(F.array(best_of(scores_in(F.col(text))))))  # a generator: evaluated once, not for each field


def table_mapping(kind: Column, text: Column) -> Column:
    """standard, spec, confidence (hundredths) of a table by its type and text, or null."""
    t = F.lower(text)
    matrix = (kind == "curriculum_matrix") | (hits(t, catalogue.MATRIX_HINTS) >= 2)
    all_of = lambda patterns: hits(t, patterns) == len(patterns)
    grading = (kind == "grading_scale") | all_of(catalogue.GRADING)
    schedule = (kind == "schedule") | all_of(catalogue.SCHEDULE)
    out = lambda s, p, c: F.struct(F.lit(s).alias("standard"), F.lit(p).alias("spec"), F.lit(c).alias("confidence"))
    return F.when(matrix, out("11", "matrix", 90)).when(grading, out("syllabus", "grading", 85)).when(schedule, out("syllabus", "schedule", 85))


def match_confidence(matched: Column, total: Column) -> Column:
    """Share of keywords that matched, 20 hundredths more with an explicit reference, 95 at most, in hundredths."""
    boost = F.when(F.exists(matched, lambda p: p.rlike(r"(?i)standard\s*\d+")), 20).otherwise(0)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(95.0), F.size(matched) * 100.0 / total + boost))
