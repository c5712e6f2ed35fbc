"""Votes of reviewers: consensus, disagreement and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import round_half_up

#: In the order that decides ties.
VOTES = ["compliant", "non_compliant", "not_applicable"]


def vote_counts(votes: DataFrame, keys: list[str], vote: str = "compliance") -> DataFrame:
    """A row per section with the number of each vote, of all votes given, and of different ones."""
    c = F.col(vote)
    counts = [F.count_if(c == v).alias(f"n_{v}") for v in VOTES]
    given = F.count(c).alias("n_votes")
    # three counts tell how many different votes there are, without a distinct aggregate
    return votes.groupBy(*keys).agg(*counts, given).withColumn("n_different", sum(((F.col(f"n_{v}") > 0).cast("long") for v in VOTES), F.lit(0).cast("long")))


def consensus_of(counts: dict[str, Column] | None = None) -> Column:
    """The most frequent vote; ties go by the order of VOTES; without votes null."""
    n = counts or {v: F.col(f"n_{v}") for v in VOTES}
    most = F.greatest(*n.values())
    out = F.when(most == 0, F.lit(None).cast("string"))
    for v in VOTES:
        out = out.when(n[v] == most, v)
    return out


def consensus(votes: DataFrame, keys: list[str], vote: str = "compliance") -> DataFrame:
    """vote_counts with consensus and disagreement."""
    return vote_counts(votes, keys, vote).withColumns({"consensus": consensus_of(), "disagreement": F.col("n_different") > 1})


#: Final recommendations that make a submission compliant.
ACCREDITING = ["accreditation_no_conditions", "conditional_accreditation"]


def outcome(recommendation: Column) -> Column:
    return F.when(recommendation.isin(ACCREDITING), "compliant").otherwise("non_compliant")


def statistics(sections: DataFrame, keys: list[str], determination: Column) -> DataFrame:
    """Counts of determinations, and the compliance rate: compliant among all but the not applicable, in percent
    (0 without sections, null if all are not applicable)."""
    d = "__determination"
    grouped = sections.withColumn(d, determination).groupBy(*keys)
    out = grouped.agg(F.count("*").alias("total"), *(F.count_if(F.col(d) == v).alias(v) for v in VOTES), F.count_if(F.col("disagreement")).alias("disagreements"))
    rate = round_half_up(F.try_divide(F.col("compliant") * 100, F.col("total") - F.col("not_applicable")))
    return out.withColumn("compliance_rate", F.when(F.col("total") == 0, F.lit(0).cast("long")).otherwise(rate))
