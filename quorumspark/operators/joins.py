"""Lookups by key, by array of keys and by name, and checks of existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import STANDARDS


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """df with columns of the matching row of dim (new name to old), null where none matches. dim_key is unique."""
    right = dim.select(F.col(dim_key).alias("__key"), *(F.col(old).alias(new) for new, old in columns.items()))
    return df.join(right, F.col(key) == F.col("__key"), "left").drop("__key")


def lookup_array(df: DataFrame, keys: str, dim: DataFrame, dim_key: str, value: str, out: str) -> DataFrame:
    """df with the array out: the values of the array's keys in their order, unknown and null keys left out; empty for a null
    array. dim_key is unique. Equal arrays are looked up once, and rows may repeat."""
    arrays = df.select(F.col(keys).alias("__keys")).where(F.col(keys).isNotNull()).distinct()
    each = arrays.select("__keys", F.posexplode("__keys").alias("__pos", "__key"))
    found = each.join(dim.select(F.col(dim_key).alias("__key"), F.col(value).alias("__value")), "__key")
    lists = found.groupBy("__keys").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__value"))), lambda x: x["__value"]).alias(out))
    empty = F.array().cast(lists.schema[out].dataType)
    return df.join(lists, F.col(keys) == F.col("__keys"), "left").drop("__keys").withColumn(out, F.coalesce(out, empty))


def standards(spark: SparkSession) -> DataFrame:
    """code, part, title of the standards."""
    return spark.createDataFrame(STANDARDS, "code string, part string, title string")


def with_standard(df: DataFrame, code: str) -> DataFrame:
    """df with part and title of the standard of a code, null for codes that are none."""
    table = F.broadcast(standards(df.sparkSession))  # a fixed table of 21 rows
    return df.join(table.withColumnRenamed("code", "__code"), F.col(code) == F.col("__code"), "left").drop("__code")


def of_part(df: DataFrame, code: str, part: str) -> DataFrame:
    """The rows of df whose code is a standard of a part (I or II)."""
    return df.where(F.col(code).isin([c for c, p, _ in STANDARDS if p == part]))


def exists_flag(df: DataFrame, key: str, other: DataFrame, other_key: str, out: str) -> DataFrame:
    """df with a boolean: whether another table has the key."""
    right = other.select(F.col(other_key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    return df.join(right, F.col(key) == F.col("__key"), "left").withColumn(out, F.col("__there").isNotNull()).drop("__key", "__there")


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
