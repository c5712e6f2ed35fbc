"""The figures of reader and compilation reports, one nested row for each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import percent, round_half_up
from .consensus import VOTES, consensus_of

#: How votes are counted in a line of a report.
SUMMARY = {"compliant": "Y", "non_compliant": "N", "not_applicable": "N/A"}


def share_text(n: Column, total: Column) -> Column:
    """12 (34%); without a total the number alone."""
    p = percent(n, total).cast("string")
    return F.concat(n.cast("string"), F.coalesce(F.concat(F.lit(" ("), p, F.lit("%)")), F.lit("")))


def summary_text(counts: dict[str, Column]) -> Column:
    """Y: 1 | N: 2 | N/A: 3."""
    return F.array_join(F.array(*(F.concat(F.lit(f"{SUMMARY[v]}: "), counts[v].cast("string")) for v in VOTES)), " | ")


def report_figures(votes: DataFrame) -> DataFrame:
    """votes: report, standard, spec, reader, compliance (null: not given). Of each report: total, the consensus counts,
    disagreements, compliance_rate (null if all is not applicable), shares (the counts as texts); standards (standard, total,
    the counts, lines: spec and votes of each) and readers (reader, asked, given, summary), both in order.

    The votes are read and shuffled once, for both the sections and the readers (grouping sets); a report is put together
    from a row for each of its standards and readers. Readers may vote on a section more than once; each vote counts. A null
    reader, standard or spec is one of its own; sections whose votes are all null count as sections without a consensus."""
    counts = [F.count_if(F.col("compliance") == v).alias(f"n_{v}") for v in VOTES]
    sets = [["report", "standard", "spec"], ["report", "reader"]]
    rows = votes.groupingSets(sets, "report", "standard", "spec", "reader").agg(*counts, F.count("*").alias("asked"), F.count("compliance").alias("given"), F.grouping("reader").alias("of_section"))
    n = {v: F.col(f"n_{v}") for v in VOTES}
    agreed = rows.withColumn("consensus", F.when(F.col("of_section") == 1, consensus_of()))
    differing = sum(((n[v] > 0).cast("int") for v in VOTES), F.lit(0)) > 1
    is_section = F.col("of_section") == 1
    line = F.when(is_section, F.struct("spec", F.col("consensus"), summary_text(n).alias("votes")))
    parts = agreed.groupBy("report", "of_section", "standard", "reader").agg(
        F.count_if(is_section).alias("total"), *(F.count_if(F.col("consensus") == v).alias(v) for v in VOTES), F.count_if(is_section & differing).alias("disagreements"),
        F.array_sort(F.collect_list(line)).alias("lines"), F.sum("asked").alias("asked"), F.sum("given").alias("given"), *(F.sum(n[v]).alias(f"n_{v}") for v in VOTES),
    )
    standard = F.when(is_section, F.struct("standard", "total", *VOTES, "lines"))
    reader = F.when(~is_section, F.struct("reader", "asked", "given", summary_text(n).alias("summary")))
    made = parts.groupBy("report").agg(*(F.sum(c).alias(c) for c in ("total", *VOTES, "disagreements")), F.array_sort(F.collect_list(standard)).alias("standards"), F.array_sort(F.collect_list(reader)).alias("readers"))
    rate = round_half_up(F.try_divide(F.col("compliant") * 100, F.col("total") - F.col("not_applicable")))
    shares = F.struct(*(share_text(F.col(v), F.col("total")).alias(v) for v in VOTES[:2]))
    return made.withColumns({"compliance_rate": rate, "shares": shares})
