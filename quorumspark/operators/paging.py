"""Pages of sorted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of a page (from 1); the order has to be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, pages, page, has_more and the numbers of the first, previous, next and last page."""
    total = F.count("*").alias("total")
    pages = F.ceil(F.col("total") / size).cast("long")
    n = F.lit(number).cast("long")
    return df.agg(total).select(
        "total", pages.alias("pages"), n.alias("page"), ((n - 1) * size + size < F.col("total")).alias("has_more"), F.lit(1).cast("long").alias("first_page"),
        F.greatest(n - 1, F.lit(1).cast("long")).alias("previous_page"), F.least(n + 1, pages).alias("next_page"), pages.alias("last_page"),
    )
