"""Rules on ordered events that hold for a finished table as for a stream's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounced(df: DataFrame, key: str, at: str, tie: str, gap: str) -> DataFrame:
    """The last event of each burst: those with no other of their key within the gap after them."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return df.withColumn("__next", following).where(F.coalesce(F.col("__next") > F.col(at) + F.expr(f"interval {gap}"), F.lit(True))).drop("__next")


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, start, last and n of each run of events with less than the gap between neighbours."""
    w = Window.partitionBy(key).orderBy(at)
    begins = F.coalesce(F.col(at) >= F.lag(at).over(w) + F.expr(f"interval {gap}"), F.lit(True)).cast("int")
    numbered = df.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(w))
    return numbered.groupBy(key, "__run").agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__run")


def fingerprint(name: Column, category: Column, message: Column) -> Column:
    return F.md5(F.concat_ws(":", name, category, F.substring(message, 1, 100)).cast("binary"))


def chunks_complete(df: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """key, received, total, complete: whatever the order of arrival, complete once each index is there."""
    return df.groupBy(key).agg(F.count_distinct(index).alias("received"), F.max(total).alias("total")).withColumn("complete", F.col("received") == F.col("total"))
