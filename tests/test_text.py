"""Document rules against slow re-statements."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quorumspark.operators import catalogue as K
from quorumspark.operators import text as X
from quorumspark.sources import views as V
from quorumspark.sources.tables import Tables

LINES = [
    "Standard 4 program evaluation and Standard 4b faculty credentials",
    "3.b field placement with cultural competence and diversity training",
    "admission, retention and dismissal of students by policies",
    "program evaluation needs assessment and evaluation of outcomes, continuous improvement",
    "counseling strategies, supervision, budget and technology for the field supervisor",
    "nothing here",
    "",
    "Standard 21a evaluation: assessment, practicum; values, ethics and mission",
    "data analysis research inquiry history of profession",
]


def restated(line: str):
    """Best standard and alternatives, walked through one by one."""
    scores: dict[str, list] = {}
    for pattern, kind, standard in K.REFERENCES:
        for m in re.finditer(pattern, line):
            if kind in ("explicit", "numeric"):
                code, spec, points = m[1], (m[2] or "").lower() or None, 95 if kind == "explicit" else 80
            elif standard:
                code, spec, points = standard, None, 60
            else:
                continue
            s = scores.setdefault(code, [0, None])
            s[0] += points
            s[1] = spec or s[1]
    for standard, lists in K.KEYWORDS.items():
        points, last = 0, None
        for spec, words in lists.items():
            for w in words:
                if w in line.lower():
                    points += 20 if spec else 30
                    last = spec or last
        if points:
            s = scores.setdefault(standard, [0, None])
            s[0] += points
            s[1] = last or s[1]
    # explicit references come first, the catalogue's standards in their order after them
    best, others = None, []
    for code, (points, spec) in scores.items():
        if best is None or points > best[1]:
            if best:
                others.append((best[0], best[2] or "a", min(95, best[1])))
            best = (code, points, spec)
        elif points > 20:
            others.append((code, spec or "a", min(95, points)))
    return (best[0], best[2] or "a", min(95, best[1]), others[:3]) if best and best[1] >= 20 else None


def test_best_and_alternative_standards(spark, data):
    own = [r["line"] for r in V.text_lines(Tables(spark, data)).select("line").distinct().collect()]
    lines = sorted({*LINES, *own})
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    best = X.best_matches(df).where("standard is not null")
    got = {r["line"]: (r["standard"], r["spec"], r["confidence"], [(a["standard"], a["spec"], a["confidence"]) for a in r["alternatives"]]) for r in best.collect()}
    assert got == {x: y for x in lines if (y := restated(x))}


def test_references_in_order(spark):
    df = spark.createDataFrame([("see standard 3B, Standard 12 and 4.c",)], "line string")
    got = [(r["standard"], r["spec"], r["confidence"]) for r in X.references(df).orderBy("pattern", "occurrence").collect()]
    assert got == [("3", "b", 95), ("12", None, 95), ("4", "c", 80)]


def test_html_blocks(spark):
    rows = [(1, i, x) for i, x in enumerate(["STANDARD 1: AIMS", "one <b>", "two & three", "", "- first", "* second", "after", "12"])]
    rows += [(2, i, x) for i, x in enumerate(["a", "", "b", "- 1. x", " ", "2) y"])]
    both = {r["doc"]: r["html"] for r in X.to_html(spark.createDataFrame(rows, "doc int, n int, line string")).collect()}
    assert both[2] == "<p>a</p>\n<p>b</p>\n<ul>\n<li>x</li>\n<li>y</li></ul>\n"
    assert both[1] == "<h1>STANDARD 1: AIMS</h1>\n<p>one &lt;b&gt; two &amp; three</p>\n<ul>\n<li>first</li>\n<li>second</li>\n</ul>\n<p>after 12</p>"


def test_html_sections(spark):
    pre = "x" * 101
    rows = [(pre + "<h1>A <i>b</i></h1>t<H1 class='c'>C</H1>",), ("short<h1>A</h1>",), ("no heading",), ("",)]
    got = spark.createDataFrame(rows, "h string").select(X.html_sections(F.col("h")).alias("s")).collect()
    assert [[(s["has_heading"], s["heading"]) for s in r["s"]] for r in got] == [[(False, ""), (True, "A b"), (True, "C")], [(True, "A")], [(False, "")], [(False, "")]]


def test_sections_drop_markers_and_carry_pages(spark):
    rows = [(1, 1, "intro"), (1, 2, "Page 4"), (1, 3, "  a\t b\tc "), (1, 4, "5"), (1, 5, "CAPS"), (1, 6, " "), (2, 1, "- item")]
    got = X.sections(spark.createDataFrame(rows, "doc int, n int, line string")).orderBy("doc", "n")
    assert [tuple(r) for r in got.select("n", "line", "page", "kind", "bold").collect()] == [
        (1, "intro", 1, "paragraph", False), (3, "a\t b\tc", 4, "table", False), (5, "CAPS", 5, "paragraph", True), (1, "- item", 1, "list", False),
    ]
