"""Latest row per group, attempts, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order, which has to be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def newest(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def attempts(df: DataFrame, keys: list[str], key: str, *order: Column) -> DataFrame:
    """df with attempt (from 1) and previous_id."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"attempt": F.row_number().over(w).cast("long"), "previous_id": F.lag(key).over(w)})
