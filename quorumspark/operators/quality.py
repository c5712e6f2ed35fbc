"""Checks of keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Keys that more than one row has (of those that pass where: a partial unique key)."""
    return (df if where is None else df.where(where)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is none of an enumeration; null is allowed."""
    return df.where(~F.col(column).isin(allowed))
