"""A session with the settings that the operators expect: UTC, ANSI mode and adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quorumspark", master: str | None = None, **conf: str) -> SparkSession:
    """conf: further settings, with _ for . in their names."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
