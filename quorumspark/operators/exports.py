"""CSV exports: lines in a total order over numbered files, below one header.

Rows are dealt out by ranges of their order and sorted in their tasks, so the files one after the other are the whole export,
and no task has more than its range. Nulls are empty cells. Lines end in a line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path


def plain(*cells: Column) -> Column:
    """Cells joined by commas as they are: commas, quotes and line feeds in them are not escaped."""
    return F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), ",")


def quoted(cell: Column) -> Column:
    """A cell in quotes, as it is."""
    return F.concat(F.lit('"'), F.coalesce(cell.cast("string"), F.lit("")), F.lit('"'))


def escaped(*cells: Column) -> Column:
    """Cells joined by commas; those with a comma, a quote or a line break are quoted, and quotes in them doubled."""

    def one(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.array_join(F.array(*map(one, cells)), ",")


def write_lines(df: DataFrame, order: list[Column], line: Column, header: str, path: str) -> None:
    """Writes the line of each row, by order, below the header."""
    spark = df.sparkSession
    keys = [f"__k{i}" for i in range(len(order))]
    rows = df.select(*(c.alias(k) for c, k in zip(order, keys, strict=True)), line.alias("value"), F.lit(1).alias("__row"))
    first = spark.range(1).select(*(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), F.lit(header).alias("value"), F.lit(0).alias("__row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["__row", *keys]
    rows.unionByName(first).repartitionByRange(parts, *by).sortWithinPartitions(*by).select("value").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), line of an export, through all its files in order."""
    meta = F.col("_metadata")
    placed = spark.read.text(path).select(F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    kept = fresh_path(spark, "lines")
    placed.write.parquet(kept)  # the numbers are those of one reading
    placed = spark.read.schema(placed.schema).parquet(kept)
    # a row for each piece of a file
    pieces = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least")).orderBy("file", "block").collect()
    before, n = [], 0
    for p in pieces:
        before.append((p["file"], p["block"], n - p["least"]))
        n += p["n"]
    offsets = spark.createDataFrame(before, "file string, block long, offset long")
    return placed.join(F.broadcast(offsets), ["file", "block"]).select((F.col("id") + F.col("offset")).alias("n"), "line")
