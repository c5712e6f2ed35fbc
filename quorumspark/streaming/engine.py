"""Running streams to their end, and operators on them that Spark has."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path


def _files(spark: SparkSession, batches: int) -> int:
    """Files of a batch: all batches together have as many as the session has shuffle partitions."""
    return max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))


def as_stream(df: DataFrame, batches: int = 4) -> DataFrame:
    """A table as a stream of so many batches, in no order."""
    spark = df.sparkSession
    path, files = fresh_path(spark, "stream-input"), _files(spark, batches)
    df.repartition(batches * files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def as_stream_in_order(df: DataFrame, at: str, batches: int = 4) -> DataFrame:
    """A table as a stream of batches in the order of a time or number: each is a range of it, written by a job of its own,
    one after the other; the stream takes files by their age. Nulls come first. A range without rows makes no batch."""
    spark = df.sparkSession
    path, files = fresh_path(spark, "stream-input"), _files(spark, batches)
    value = (F.col(at).cast("timestamp") if df.schema[at].dataType.typeName().startswith("timestamp") else F.col(at)).cast("double")
    bounds = df.select(value.alias("v")).where("v is not null").approxQuantile("v", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else value > low
        inside &= F.lit(True) if high is None else value <= high
        df.where(F.coalesce(inside, F.lit(low is None))).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, as transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, mode: str = "append", timeout_s: int | None = None) -> DataFrame:
    """What a stream emits until its input ends, with batch_id, as a table in the shared folder. Each batch is
    written under its number, so a batch that is run again replaces what it wrote. timeout_s: None for as long as it takes."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream-output"), fresh_path(spark, "stream-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with state_in_rocksdb(spark):
        started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            if started.awaitTermination(timeout_s) is False:  # None where there is no limit
                raise TimeoutError(f"the stream took more than {timeout_s} s")
        finally:
            started.stop()
    schema = stream.schema.add("batch_id", "integer")
    if not spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(out)):
        return spark.createDataFrame([], schema)  # no batch ran
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def last_update(updates: DataFrame, *keys: str) -> DataFrame:
    """Of the updates of each key the one of the last batch."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def running_counts(stream: DataFrame, key: Column, at: str) -> DataFrame:
    """For update mode: key, occurrences, first and last time of each key so far."""
    return stream.groupBy(key.alias("key")).agg(F.count("*").alias("occurrences"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def closed_sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """For append mode: key, start, last and n of sessions that the watermark has closed."""
    windows = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return windows.agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def foreach_row_batch(stream: DataFrame, send: Callable[[Iterator], None], every: str, checkpoint: str):
    """Starts a stream that hands each batch's rows to send on the executors, a partition at a time as they come, so often."""

    def hand_over(batch: DataFrame, _: int) -> None:
        batch.foreachPartition(send)

    return stream.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
