"""Tables that are replaced as a whole: readers see the rows of before or of after, never a part.

A table is a folder of versions, each a folder of Parquet files, and of manifests that name them. A version counts once its
manifest is there, and that comes by renaming a finished file; a write that fails, or is still running, leaves the version of
before in force. Old versions stay for readers that have begun, until vacuum() takes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DIGITS = 20


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The number of each version that counts, with its folder's name."""
    files, at = _folder(spark, f"{path}/_manifests")
    if not files.exists(at):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return {int(n[:DIGITS]): n[DIGITS + 1 :] for n in names if len(n) > DIGITS and n[:DIGITS].isdigit() and n[DIGITS] == "-"}


def replace(df: DataFrame, path: str) -> int:
    """Replaces the table's rows, which df may be made from; returns the new version's number. Of writers at one time each
    gets a number of its own, and the highest counts."""
    spark = df.sparkSession
    files, _ = _folder(spark, path)
    name = f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")  # if this fails, no manifest names what it left
    manifests = f"{path}/_manifests"
    files.mkdirs(_path(spark, manifests))
    number = max(versions(spark, path), default=0)
    while True:
        number += 1
        claim = _path(spark, path, "_claims", f"{number:0{DIGITS}d}")
        try:
            files.create(claim, False).close()  # fails if another writer has the number
            break
        except Exception as e:  # noqa: BLE001  the JVM's "already exists"
            if not files.exists(claim):
                raise RuntimeError(f"no manifest could be written below {path}") from e
    draft = _path(spark, path, "_claims", f"{name}.draft")
    files.create(draft, True).close()
    if not files.rename(draft, _path(spark, manifests, f"{number:0{DIGITS}d}-{name}")):
        raise RuntimeError(f"no manifest could be written below {path}")
    return number


def current(spark: SparkSession, path: str, schema=None, version: int | None = None) -> DataFrame:
    """The table's rows, as of now or of a version; what is read later is still the version that was found here."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"{path} has no version{'' if version is None else f' {version}'}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/{found[max(found) if version is None else version]}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes all but the newest versions. Folders without a manifest stay, as they may be writes that are running."""
    files, _ = _folder(spark, path)
    found = versions(spark, path)
    for number in sorted(found)[: max(0, len(found) - keep)]:
        files.delete(_path(spark, path, "_manifests", f"{number:0{DIGITS}d}-{found[number]}"), False)
        files.delete(_path(spark, path, found[number]), True)
