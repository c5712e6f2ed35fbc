"""Filters: optional terms, access rules and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import week_start


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each column whose value is given; null, empty text, 0 and False drop the term."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def any_contains(q: str, *columns: Column) -> Column:
    """Whether a text occurs in any of the columns, whatever the case."""
    test = F.lit(False)
    for x in columns:
        test = test | F.coalesce(F.lower(x).contains(q.lower()), F.lit(False))
    return test


def any_element_contains(q: str, *arrays: Column) -> Column:
    """Whether a text occurs in any element of the arrays, whatever the case."""
    test = F.lit(False)
    for xs in arrays:
        test = test | F.coalesce(F.exists(xs, lambda x: F.lower(x).contains(q.lower())), F.lit(False))
    return test


def within_days(moment: Column, now: Column, days: int) -> Column:
    """From now to days later, both ends included."""
    return moment.between(now, now + F.expr(f"interval {days} days"))


def calendar(moment: Column, period: str, now: Column) -> Column:
    """Within a period around now: today, this_week (from Sunday), this_month or last_month."""
    day, today = F.to_date(moment), F.to_date(now)
    month = F.date_trunc("month", today).cast("date")
    return {
        "today": day == today,
        "this_week": (day >= week_start(today)) & (day < F.date_add(week_start(today), 7)),
        "this_month": (day >= month) & (day < F.add_months(month, 1)),
        "last_month": (day >= F.add_months(month, -1)) & (day < month),
    }[period]


def expired(until: Column, now: Column) -> Column:
    """Whether an end has passed; without one, never."""
    return F.coalesce(until < now, F.lit(False))


def in_team(team: Column, own: str | None) -> Column:
    """Rows of the own team and of none; without an own team all rows."""
    return F.lit(True) if own is None else team.isNull() | (team == own)


def visible(role: str, *, institution: Column, own_institution, reader_ids: Column, user) -> Column:
    """Admins see all, coordinators their institution, readers what they are assigned to, others nothing."""
    if role == "admin":
        return F.lit(True)
    if role == "coordinator":
        return F.coalesce(institution == own_institution, F.lit(False))
    if role in ("reader", "lead_reader"):
        return F.coalesce(F.array_contains(reader_ids, user), F.lit(False))
    return F.lit(False)


def may_edit(role: str, *, locked: Column, sent_back: Column, own: Column, readers: Column, user) -> Column:
    """Admins always; coordinators while unlocked, what is theirs or was sent back; readers where assigned."""
    if role == "admin":
        return F.lit(True)
    if role == "coordinator":
        return ~locked & (sent_back | own)
    if role in ("reader", "lead_reader"):
        return F.coalesce(F.array_contains(readers, user), F.lit(False))
    return F.lit(False)


def may_lock(*, locked: Column, locked_by: Column, readers: Column, user) -> Column:
    """Those assigned may lock what nobody else has locked."""
    return F.coalesce(F.array_contains(readers, user), F.lit(False)) & (~locked | locked_by.eqNullSafe(user))


def may_unlock(role: str, *, locked: Column, locked_by: Column, user) -> Column:
    """Admins, lead readers and whoever locked it may unlock what is locked."""
    return locked & (F.lit(role in ("admin", "lead_reader")) | locked_by.eqNullSafe(user))
