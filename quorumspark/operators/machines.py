"""Status machines: a table of moves applied to the ordered events of each key.

An event is a function from states to states. Events are sorted by key and order over all tasks (one sort by range), and each
task walks its rows once, as they come. Its first key may have begun in the tasks before it, so for that key's rows it tells
the state for each that the task may begin with; what the key comes to is a function, too. These, two rows a task at most, are
chained and tell with which state each task begins. So a key with very many events is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh_path

CHUNK = 8192

#: Moves by state and event. An import can be cancelled until it has ended; a load's report counts as loaded
#: whatever it says, unless it tells of an error, and in any state.
IMPORT = {
    ("pending", "start"): "processing", ("processing", "complete"): "completed", ("processing", "fail"): "failed", ("pending", "fail"): "failed",
    ("pending", "cancel"): "cancelled", ("processing", "cancel"): "cancelled", ("failed", "start"): "processing",
}
LOAD_STATES = ["not_loaded", "loading", "loaded", "error"]
LOAD = {(s, "trigger"): "loading" for s in LOAD_STATES} | {(s, "error"): "error" for s in LOAD_STATES} | {(s, "report"): "loaded" for s in LOAD_STATES}


def load_event(status: Column) -> Column:
    """What a load's report means: an unknown status, or none, counts as loaded."""
    return F.when(status == "trigger", "trigger").when(status.isin("error", "failed"), "error").otherwise("report")


def run_machine(events: DataFrame, key: str, order: list[str], event: Column, moves: Mapping[tuple[str, str], str], start: str, chunk: int = CHUNK) -> DataFrame:
    """events with before, after and legal: the states around each event of its key, by order (its ties are in any order). An
    event without a move from the state (an unknown or null one too) is illegal and leaves it. Events of a null key are one
    key's; a null in order comes first. A task hands its rows over by chunks of so many. No column may be named like one of
    the three or start with __."""
    spark = events.sparkSession
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    names = sorted({e for _, e in moves})
    stays = list(range(len(states)))
    table = [[states.index(moves.get((s, e), s)) for s in states] for e in names] + [stays]
    legal = [(s, e) in moves for e in names for s in states] + [False] * len(states)
    array = lambda xs: F.array(*map(F.lit, xs))
    number = F.coalesce(F.nullif(F.array_position(array(names), event), F.lit(0)) - 1, F.lit(len(names))).cast("int")
    begin = states.index(start)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with __before (its state) or, in the first key, __each (that for each state to begin with); then, without
        events, what the first key and, if there are more, the last one came to."""
        task, own = TaskContext.get().partitionId(), [("__task", pa.int32()), ("__end", pa.bool_()), ("__before", pa.int32()), ("__each", pa.list_(pa.int32()))]
        keys, now, each, one, schema, first, last = 0, None, stays, begin, None, None, None

        def made(batch: pa.RecordBatch, end: bool, before: list, each: list) -> pa.RecordBatch:
            n = batch.num_rows
            more = [[task] * n, [end] * n, before, each]
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, (_, t) in zip(more, own, strict=True))], names=[*batch.schema.names, *(k for k, _ in own)])

        def ended(value: pa.Array, before: int | None, each: list | None) -> pa.RecordBatch:
            alone = pa.RecordBatch.from_arrays([value if f.name == key else pa.nulls(1, f.type) for f in schema], names=schema.names)
            return made(alone, True, [before], [each])

        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                values, schema, before, eachs = batch.column(key), batch.schema, [], []
                for k, e in zip(values.to_pylist(), batch.column("__e").to_pylist(), strict=True):
                    if keys == 0 or not (k == now or (k != k and now != now)):
                        keys, now, one = keys + 1, k, begin
                    if keys == 1:
                        before.append(None)
                        eachs.append(each)
                        each = [table[e][s] for s in each]
                    else:
                        before.append(one)
                        eachs.append(None)
                        one = table[e][one]
                first, last = values.slice(0, 1) if first is None else first, values.slice(len(values) - 1, 1)
                yield made(batch, False, before, eachs)
        if keys:
            yield ended(first, None, each)
        if keys > 1:
            yield ended(last, one, None)

    path, parts = fresh_path(spark, "machine"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.asc_nulls_first(c) for c in (key, *order)]
    placed = events.withColumn("__e", number).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    fields = [T.StructField(f.name, f.dataType) for f in placed.schema] + [T.StructField("__task", T.IntegerType()), T.StructField("__end", T.BooleanType()), T.StructField("__before", T.IntegerType()), T.StructField("__each", T.ArrayType(T.IntegerType()))]
    placed.mapInArrow(walked, T.StructType(fields)).write.parquet(path)
    placed = spark.read.schema(T.StructType(fields)).parquet(path)

    same = lambda a, b: a == b or (a != a and b != b)
    begins, last, state = [], None, begin
    ends = placed.where("__end").select("__task", F.col(f"`{key}`"), "__before", "__each").collect()  # two rows a task at most
    for task, value, before, each in sorted(ends, key=lambda r: (r["__task"], r["__each"] is None)):
        if each is not None:
            state = state if begins and same(value, last) else begin
            begins.append((task, state))
        last, state = value, before if each is None else each[state]
    begun = F.broadcast(spark.createDataFrame(begins, "__task int, __begin int"))
    rows = placed.where("not __end").join(begun, "__task").withColumn("__s", F.coalesce("__before", F.get("__each", F.col("__begin"))))
    move = F.col("__e") * len(states) + F.col("__s")
    after = F.get(array([states[s] for row in table for s in row]), move)
    return rows.select(*(F.col(f"`{c}`") for c in events.columns), F.get(array(states), F.col("__s")).alias("before"), after.alias("after"), F.get(array(legal), move).alias("legal"))
