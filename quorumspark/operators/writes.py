"""Writes as frames: upserts, bulk updates, nested edits and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, only_filled: bool = False) -> DataFrame:
    """old with rows of new by key (unique on either side) added or replacing; with only_filled, nulls and empty
    texts of new leave the old value."""
    names = [c for c in old.columns if c != key]
    kinds = dict(old.dtypes)

    def value(name: str) -> Column:
        a, b = F.col(f"n.{name}"), F.col(f"o.{name}")
        if only_filled:
            return F.coalesce(F.nullif(a, F.lit("")) if kinds[name] == "string" else a, b)
        return F.when(F.col("n.__new"), a).otherwise(b)

    joined = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(value(x).alias(x) for x in names))


def append_to(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table, which is made if need be."""
    df.write.mode("append").parquet(path)


def update_where(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """df with columns set in the rows of a test."""
    return df.withColumns({k: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(k)) for k, v in values.items()})


def delete_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone, key, "left_anti")


def clear_reference(df: DataFrame, reference: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """df with the reference null where it points to a deleted row."""
    right = gone.select(F.col(gone_key).alias("__gone")).distinct()
    return df.join(right, F.col(reference) == F.col("__gone"), "left").withColumn(reference, F.when(F.col("__gone").isNull(), F.col(reference))).drop("__gone")


def append_on_change(history: Column, old: Column, new: Column, entry: Column) -> Column:
    """The history with an entry more if a value changed."""
    return F.when(~old.eqNullSafe(new), F.array_append(history, entry)).otherwise(history)


def without_key(items: Column, field: str, key: Column) -> Column:
    """An array of structs without those whose field equals the key."""
    return F.filter(items, lambda x: ~x[field].eqNullSafe(key))


def nested_upsert(flat: DataFrame, changes: DataFrame, keys: list[str], value: str, order: str, parts: int | None = None) -> DataFrame:
    """Cells by keys with the last change of each applied; cells whose value is null afterwards go. With parts, cells and
    last changes meet in so many tasks, apart from those that find them, so that no task holds both steps."""
    last = changes.groupBy(*keys).agg(F.max_by(value, order).alias("__value"), F.lit(True).alias("__changed"))
    if parts:
        flat, last = flat.repartition(parts, *keys), last.repartition(parts, *keys)
    joined = flat.join(last, keys, "full_outer")
    return joined.withColumn(value, F.when(F.coalesce("__changed", F.lit(False)), F.col("__value")).otherwise(F.col(value))).drop("__value", "__changed").where(F.col(value).isNotNull())
