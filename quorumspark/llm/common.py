"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: For bytes.translate: A-Z to a-z, all else unchanged.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so that later steps neither repeat
    the work before nor depend on the executors that did it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that spread_join() sends to every executor at most, and rows from which a key counts as hot at least.
HOT_KEYS, HOT_ROWS = 10_000, 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, n: str = "n", how: str = "inner", fewest: int = 0) -> DataFrame:
    """left joined with right, which has one row for each key and in n how many rows of left have it, fewest at least;
    rows: of left, at least. No key's rows meet in one task beyond a bound: those of hot keys stay where they are, and what right has
    for them, rows / (rows / HOT_KEYS) = HOT_KEYS keys at most, goes to every executor."""
    most = max(HOT_ROWS, rows // HOT_KEYS)
    hot, own = fresh("hot"), [c for c in right.columns if c not in (*keys, n)]
    if fewest > most:  # all keys are hot
        return left.join(F.broadcast(right.drop(n)), keys, how)
    few = F.broadcast(right.where(F.col(n) > most).select(*keys, *own, F.lit(True).alias(hot)))
    marked = left.join(few, keys, "left")
    return marked.where(hot).drop(hot).unionByName(marked.where(F.col(hot).isNull()).drop(hot, *own).join(right.where(F.col(n) <= most).drop(n), keys, how))


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a thousand at a time, unless the session says otherwise: texts are long, and batches of
    Spark's default of 10,000 fill both sides' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def tidily(work):
    """A function of batches that gives memory back when it has ended."""

    def run(parts):
        yield from work(parts)
        trim_memory()

    return run


def trim_memory() -> None:
    """Returns freed memory to the system, as a Python worker lives on idle after its task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
