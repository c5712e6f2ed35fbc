"""Counters and states that change when something is used: keys with a use count, an expiry and a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def used_keys(keys: DataFrame, uses: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """keys: key (unique), active, expires_at and use_limit (null: none), used, last_used_at. uses: key, at (its ties count as
    one after the other). keys with the uses merged in, refused (uses that did not count) and state as of now: inactive,
    exhausted, expired or active, the first that holds.

    A use counts if its key is active, at is not after expires_at, and the limit is not reached. Without a limit that is a sum
    and a maximum, so a key with very many uses is added up before it is shuffled; only uses of keys with a limit are sorted.
    Uses of unknown or null keys, and at null times, do not count; null in active means no."""
    known = keys.select(key, F.coalesce("active", F.lit(False)).alias("__active"), F.col("expires_at").alias("__expires"), F.when(F.col("use_limit").isNotNull(), F.greatest(F.col("use_limit") - F.coalesce("used", F.lit(0)), F.lit(0))).alias("__left"))
    seen = uses.where(F.col(at).isNotNull()).select(key, F.col(at).alias("__at")).join(known, key)
    valid = F.col("__active") & F.coalesce(F.col("__at") <= F.col("__expires"), F.lit(True))
    count = lambda df, counts: df.groupBy(key).agg(F.count("*").alias("__all"), F.count_if(counts).alias("__n"), F.max(F.when(counts, F.col("__at"))).alias("__last"))
    free = count(seen.where("__left is null"), valid)
    ranked = seen.where("__left is not null").withColumn("__valid", valid)
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__valid").orderBy("__at")))
    limited = count(ranked, F.col("__valid") & (F.col("__rank") <= F.col("__left")))
    merged = keys.join(free.unionByName(limited), key, "left")
    used = F.coalesce("used", F.lit(0)) + F.coalesce("__n", F.lit(0))
    state = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive")
        .when(F.coalesce(used >= F.col("use_limit"), F.lit(False)), "exhausted")
        .when(F.coalesce(F.col("expires_at") < now, F.lit(False)), "expired")
        .otherwise("active")
    )
    values = {"state": state, "refused": F.coalesce(F.col("__all") - F.col("__n"), F.lit(0)), "last_used_at": F.greatest("last_used_at", "__last"), "used": used}
    return merged.select(*(c for c in keys.columns if c not in values), *(v.alias(k) for k, v in values.items()))
