"""Webhook delivery: requests with their headers, an outbox that sends each until it is answered, and its log.

What was answered is in the log, a Parquet table that only grows: a batch that runs again, or a stream that restarts, sends
what the log does not have as answered. A task that is lost between an answer and its log entry sends again, so each request
carries its id as Idempotency-Key, by which the receiver can tell.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: milliseconds where a webhook has no timeout of its own.
TIMEOUT_MS = 30_000

LOG = "id string, attempt int, success boolean, status int, execution_id string, error string, response_ms long"

#: Gets url, headers, body and timeout in seconds, and returns the status and the text of the answer; raises if none comes.
Sender = Callable[[str, dict[str, str], str, float], tuple[int, str]]


def headers(request_id: Column, auth_type: Column, api_key: Column, bearer_token: Column, extra: Column) -> Column:
    """The headers of a request: authentication by key or bearer token if its type asks for it and it is there; extra, a map
    or null, goes before all others."""
    filled = lambda x: x.isNotNull() & (x != "")
    none = F.create_map().cast("map<string,string>")
    one = lambda name, value: F.create_map(F.lit(name), value)
    base = F.map_concat(
        one("Content-Type", F.lit("application/json")), one("Idempotency-Key", request_id.cast("string")),
        F.when((auth_type == "api_key") & filled(api_key), one("X-API-Key", api_key)).otherwise(none),
        F.when((auth_type == "bearer") & filled(bearer_token), one("Authorization", F.concat(F.lit("Bearer "), bearer_token))).otherwise(none),
    )
    more = F.coalesce(extra, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def post(url: str, headers: dict[str, str], body: str, timeout_s: float) -> tuple[int, str]:
    """Sends by HTTP."""
    request = urllib.request.Request(url, body.encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return answer.status, answer.read().decode(errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def execution_of(text: str) -> str | None:
    """executionId, or else id, of an answer; an answer that is no JSON is an error."""
    found = json.loads(text)
    value = (found.get("executionId") or found.get("id")) if isinstance(found, dict) else None
    return None if value is None else str(value)


def answered(requests: DataFrame, send: Sender) -> DataFrame:
    """Sends each request (id, url, headers, body, timeout_ms, attempt) where it lies, one after the other, and returns LOG. What
    a task writes there lies in the log when the task has ended, so entries are handed over by batches of requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("attempt", pa.int32()), ("success", pa.bool_()), ("status", pa.int32()), ("execution_id", pa.string()), ("error", pa.string()), ("response_ms", pa.int64())])
        for batch in batches:
            entries = []
            for row in batch.to_pylist():
                began, status, found, error = time.monotonic(), None, None, None
                try:
                    status, text = send(row["url"], dict(row["headers"]), row["body"], row["timeout_ms"] / 1000)
                    if 200 <= status < 300:
                        found = execution_of(text)
                    else:
                        error = f"the receiver returned {status}"
                except Exception as e:  # noqa: BLE001  whatever went wrong is in the log
                    error = str(e) or type(e).__name__
                entries.append({"id": row["id"], "attempt": row["attempt"], "success": error is None, "status": status, "execution_id": found, "error": error, "response_ms": int(1000 * (time.monotonic() - began))})
            yield pa.RecordBatch.from_pylist(entries, schema)

    return requests.mapInArrow(run, LOG)


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path)


def deliver(requests: DataFrame, log: str, send: Sender = post, attempts: int = 3) -> None:
    """Sends requests (id, url, headers, body, timeout_ms: null or below 1 is TIMEOUT_MS) that the log does not have as
    answered, up to so many times each. A request without an id or url is not sent; of requests of one id one is."""
    spark = requests.sparkSession
    timeout = F.when(F.col("timeout_ms") >= 1, F.col("timeout_ms")).otherwise(TIMEOUT_MS).cast("long")
    fit = requests.where("id is not null and url is not null").select(F.col("id").cast("string").alias("id"), "url", "headers", "body", timeout.alias("timeout_ms"))
    for _ in range(attempts):
        tried = log_of(spark, log).groupBy("id").agg(F.max("attempt").alias("before"), F.bool_or("success").alias("done"))
        due = fit.join(tried, "id", "left").where("not coalesce(done, false) and coalesce(before, 0) < " + str(attempts)).dropDuplicates(["id"])
        due = due.select(*fit.columns, (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("attempt"))
        path = f"{log}/{uuid.uuid4().hex}"
        answered(due, send).write.parquet(path)
        if spark.read.schema(LOG).parquet(path).where("not success").isEmpty():
            break


def deliver_stream(stream: DataFrame, log: str, checkpoint: str, send: Sender = post, attempts: int = 3, **trigger):
    """Starts a stream that delivers each batch of requests; trigger as in DataStreamWriter.trigger()."""
    return stream.writeStream.foreachBatch(lambda batch, _: deliver(batch, log, send, attempts)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """id, attempts, success, execution_id, error of each request so far: the answer, or the last attempt's error."""
    last = F.max_by(F.struct("execution_id", "error"), F.struct("success", "attempt"))
    return log_of(spark, log).groupBy("id").agg(F.max("attempt").alias("attempts"), F.bool_or("success").alias("success"), last.alias("l")).select("id", "attempts", "success", "l.*")
