"""Hand-worked cases of semantics that the tables do not reach."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quorumspark.functions import semantics as S
from quorumspark.operators import consensus as C
from quorumspark.operators import filters as O
from quorumspark.operators import joins as J
from quorumspark.operators import paging as P
from quorumspark.operators import writes as W


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_rounding_goes_up_at_halves(spark):
    got = values(spark, [(-2.5,), (2.5,), (0.49,), (-0.5,)], "x double", S.round_half_up(F.col("x")))
    assert got == [(-2,), (3,), (0,), (0,)]


def test_percent_of_nothing_is_null(spark):
    assert values(spark, [(1, 0), (1, 3)], "a int, b int", S.percent(F.col("a"), F.col("b"))) == [(None,), (33,)]


def test_not_in_and_not_equal_keep_null(spark):
    rows = [("a",), (None,), ("b",)]
    assert values(spark, rows, "x string", S.not_in(F.col("x"), ["a"])) == [(False,), (True,), (True,)]
    assert values(spark, rows, "x string", S.not_in(F.col("x"), [])) == [(True,)] * 3
    assert values(spark, rows, "x string", S.not_equal(F.col("x"), "a")) == [(False,), (True,), (True,)]
    assert values(spark, rows, "x string", S.not_equal(F.col("x"), None)) == [(True,), (False,), (True,)]


def test_in_nothing_matches_nothing(spark):
    assert spark.range(3).where(F.col("id").isin([])).count() == 0


def test_optional_terms_drop_what_is_falsy(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "x string, n int")
    assert O.optional(df, x="", n=0).count() == 2
    assert O.optional(df, x="b", n=None).count() == 1


def test_week_starts_on_sunday(spark):
    rows = [(datetime.date(2024, 1, d),) for d in (13, 14, 20, 21)]
    got = [r[0].day for r in values(spark, rows, "d date", S.week_start(F.col("d")))]
    assert got == [7, 14, 14, 21]


def test_calendar_last_month_over_new_year(spark):
    now = F.lit(datetime.datetime(2024, 1, 3))
    rows = [(datetime.datetime(2023, 12, 1),), (datetime.datetime(2023, 12, 31, 23, 59),), (datetime.datetime(2024, 1, 1),), (datetime.datetime(2023, 11, 30),)]
    assert values(spark, rows, "t timestamp", O.calendar(F.col("t"), "last_month", now)) == [(True,), (True,), (False,), (False,)]


def test_within_days_has_both_ends(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(now,), (now + datetime.timedelta(days=14),), (now + datetime.timedelta(days=14, seconds=1),), (None,)]
    assert values(spark, rows, "t timestamp", O.within_days(F.col("t"), F.lit(now), 14)) == [(True,), (True,), (False,), (None,)]


def test_expiry_without_end_never_comes(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    assert values(spark, [(None,), (datetime.datetime(2023, 1, 1),)], "t timestamp", O.expired(F.col("t"), now)) == [(False,), (True,)]


def test_broken_pattern_is_looked_for_as_text(spark):
    rows = [("A(b",), ("ab",)]
    assert values(spark, rows, "x string", S.matches(F.col("x"), "a(")) == [(True,), (False,)]
    assert values(spark, rows, "x string", S.matches(F.col("x"), "^a.?b")) == [(True,), (True,)]
    # Java's dialect decides: the first is none there, the second is
    assert values(spark, [("(?p<n>a)",), ("a",)], "x string", S.matches(F.col("x"), "(?P<n>a)")) == [(True,), (False,)]
    assert values(spark, [("éxc",), ("1c",)], "x string", S.matches(F.col("x"), r"\p{L}+x*c")) == [(True,), (False,)]


@pytest.mark.parametrize(
    ("votes", "expected"),
    [
        (["compliant", "non_compliant"], ("compliant", True)),
        (["not_applicable", "non_compliant"], ("non_compliant", True)),
        (["not_applicable", None, "not_applicable"], ("not_applicable", False)),
        ([None, None], (None, False)),
        (["compliant", "non_compliant", "non_compliant"], ("non_compliant", True)),
    ],
)
def test_consensus(spark, votes, expected):
    df = spark.createDataFrame([("s", v) for v in votes], "section string, compliance string")
    assert [tuple(r) for r in C.consensus(df, ["section"]).select("consensus", "disagreement").collect()] == [expected]


def test_compliance_rate_is_null_if_nothing_applies(spark):
    df = spark.createDataFrame([("s", "not_applicable"), ("t", "compliant"), ("t", "compliant")], "section string, compliance string")
    got = C.statistics(C.consensus(df, ["section"]), ["section"], F.col("consensus"))
    assert {(r["section"], r["compliance_rate"]) for r in got.collect()} == {("s", None), ("t", 100)}


def test_page_info_of_an_empty_list(spark):
    r = P.page_info(spark.range(0), 1, 10).first()
    assert (r["total"], r["pages"], r["has_more"], r["previous_page"]) == (0, 0, False, 1)


def test_upsert_and_filled_only(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, n int")
    new = spark.createDataFrame([(2, "", None), (3, "c", 3)], "k int, x string, n int")
    assert sorted(map(tuple, W.upsert(old, new, "k").collect())) == [(1, "a", 1), (2, "", None), (3, "c", 3)]
    assert sorted(map(tuple, W.upsert(old, new, "k", only_filled=True).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]


def test_history_grows_only_on_change(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), (None, "b")], "o string, n string")
    got = df.select(F.size(W.append_on_change(F.array(F.lit("x")), F.col("o"), F.col("n"), F.lit("y")))).collect()
    assert [r[0] for r in got] == [1, 2, 1, 2]


def test_nested_upsert_takes_the_last_change_and_drops_emptied_cells(spark):
    flat = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "s string, p int, v string")
    changes = spark.createDataFrame([("a", 2, "z", 1), ("a", 2, "w", 2), ("b", 1, "n", 1)], "s string, p int, v string, at int")
    got = W.nested_upsert(flat, changes, ["s", "p"], "v", "at")
    assert sorted(map(tuple, got.select("s", "p", "v").collect())) == [("a", 1, "x"), ("a", 2, "w"), ("b", 1, "n")]


def test_row_access(spark):
    df = spark.createDataFrame([(1, [7]), (None, None)], "inst int, readers array<int>")
    see = lambda role: [r[0] for r in df.select(O.visible(role, institution=F.col("inst"), own_institution=1, reader_ids=F.col("readers"), user=7)).collect()]
    assert see("admin") == [True, True]
    assert see("coordinator") == see("reader") == [True, False]
    assert see("other") == [False, False]


def test_lookup_of_arrays_in_repeated_rows(spark):
    rows = [(1, [2, 1, 9]), (1, [2, 1, 9]), (1, [3]), (2, None), (3, []), (4, [None, 1, 1])]
    df = spark.createDataFrame(rows, "id int, ks array<int>")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    got = J.lookup_array(df, "ks", dim, "k", "v", "vs").collect()
    assert sorted(((r["id"], r["vs"]) for r in got), key=repr) == [(1, ["b", "a"]), (1, ["b", "a"]), (1, [None]), (2, []), (3, []), (4, ["a", "a"])]
