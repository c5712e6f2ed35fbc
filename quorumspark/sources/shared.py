"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. What an application writes there lies in a folder of its
    own, which can go when the application has ended."""
    return f"{shared_dir(spark)}/quorumspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
