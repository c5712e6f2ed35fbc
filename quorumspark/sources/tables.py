"""Scans of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The Parquet tables of a folder as attributes: Tables(spark, path).orders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small constant table."""
        return self.spark.createDataFrame(rows, schema)
