"""Small column functions with fixed semantics: rounding, trimming, null handling, text and time."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Rounds to a whole number, halves towards positive infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; null if whole is 0."""
    return round_half_up(F.try_divide(part * 100, whole))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def not_equal(x: Column, value) -> Column:
    """Unequal, where null differs from every value and equals null."""
    return ~x.eqNullSafe(value)


def not_in(x: Column, values: list) -> Column:
    """In none of the values; null is in none."""
    return ~F.coalesce(x.isin(values), F.lit(False)) if values else F.lit(True)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(blank_to_null, xs))


def shortened(x: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def masked(x: Column, shown: int = 4) -> Column:
    """All but the last characters as stars; all of a text that is no longer than shown."""
    return F.when(F.length(x) > shown, F.concat(F.repeat(F.lit("*"), F.length(x) - shown), F.right(x, F.lit(shown)))).otherwise(F.repeat(F.lit("*"), F.length(x)))


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(F.date_trunc("week", F.date_add(day, 1)).cast("date"), 1)


def days_until(moment: Column, now: Column) -> Column:
    """Days from now, begun ones included."""
    return F.ceil((F.unix_timestamp(moment) - F.unix_timestamp(now)) / 86400).cast("long")


def urgency(days: Column) -> Column:
    return F.when(days <= 14, "urgent").when(days <= 30, "warning").otherwise("normal")


def phone(x: Column) -> Column:
    """(ddd) ddd-dddd as far as the digits go, of which ten count."""
    d = F.substring(F.regexp_replace(x, r"\D", ""), 1, 10)
    return (
        F.when(d == "", d)
        .when(F.length(d) <= 3, F.concat(F.lit("("), d))
        .when(F.length(d) <= 6, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3)))
        .otherwise(F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))
    )


def toggled(values: Column, x: Column) -> Column:
    """An array without x if it holds x, else with x at its end."""
    return F.when(F.array_contains(values, x), F.array_remove(values, x)).otherwise(F.array_append(values, x))


def base64_line(x: Column) -> Column:
    """Base 64 without line ends."""
    return F.regexp_replace(F.base64(x), r"[\r\n]", "")


def matches(x: Column, pattern: str) -> Column:
    """Whether the pattern occurs, whatever the case; a pattern that is no regular expression is looked for as text.
    Java decides, as Java runs it."""
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except (Py4JJavaError, IllegalArgumentException):
        return F.lower(x).contains(pattern.lower())
    return x.rlike(f"(?i){pattern}")


def hits(x: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + x.rlike(p).cast("int")
    return total


def first_kind(x: Column, kinds: dict[str, list[str]], least: int = 2, other: str | None = None) -> Column:
    """The first kind of which at least so many patterns occur."""
    out = None
    for kind, patterns in kinds.items():
        test = hits(x, patterns) >= least
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(other)
