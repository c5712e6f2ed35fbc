"""Operators with state of their own, for transformWithState: error episodes, chunk assembly, payloads with a time to live.

Times are microseconds as longs. What a trigger brings for a key is worked through in order of time (or of arrival) and
then of id; across triggers rows are taken as they come. A trigger's rows of one key are in one task's memory, so the
trigger's size is the bound. Null times count as 0. Keys may be null. Each function takes a stream (its columns are named
in its docstring; others play no part) and returns one in update mode, of which streaming.engine.last_update() keeps what
holds at last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


#: Places of what every row has, after its key; an operator's own columns follow.
AT, ID, OWN = 1, 2, 3


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r[AT] or 0, r[ID] is not None, r[ID] or 0))


def _keyed(stream: DataFrame, key: Column, at: Column, tie: Column, **columns: Column) -> DataFrame:
    own = (v.alias(k) for k, v in columns.items())
    return stream.select(key.alias("key"), at.cast("long").alias("at"), tie.cast("long").alias("id"), *own, *(c for c in ("event_time",) if c in stream.columns))


EPISODE = "key string, first_at long, first_id long, occurrences long, last_at long, resolved_at long, expired_at long"


class Episodes(StatefulProcessor):
    """Counts a key's rows until one resolves it; later ones begin anew. With ttl (microseconds), an episode is told as
    expired, and forgotten, once the watermark is so far past its resolution. Resolved episodes lie in boxes by the time when
    they are due, a ninetieth of ttl each; a box has one timer, for the first that is due in it."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_at long, first_id long, occurrences long, last_at long")
        if self.ttl is not None:
            self.width = max(1, self.ttl // 90 // 1000)  # milliseconds
            # by box: when its episodes began, how many rows they had, the last, and when they were resolved
            self.resolved = handle.getMapState("resolved", "box long", "first_at array<long>, first_id array<long>, occurrences array<long>, last_at array<long>, resolved_at array<long>")

    def due(self, resolved_at: int) -> int:
        return (resolved_at + self.ttl) // 1000

    def held(self, box: int) -> list[tuple]:
        found = self.resolved.getValue((box,))
        return [] if found is None else list(zip(*found, strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = self.open.get()
        ended: dict[int, list[tuple]] = {}
        for row in _in_order(rows):
            at = row[AT] or 0
            if not row[OWN]:
                now = (at, row[ID], 1, at) if now is None else (now[0], now[1], now[2] + 1, at)
            elif now is not None:
                yield Row(key=key[0], first_at=now[0], first_id=now[1], occurrences=now[2], last_at=now[3], resolved_at=at, expired_at=None)
                if self.ttl is not None:
                    ended.setdefault(self.due(at) // self.width, []).append((*now, at))
                now = None
        for box, more in ended.items():
            before = self.held(box)
            self.resolved.updateValue((box,), tuple(map(list, zip(*before, *more, strict=True))))
            first, was = min(self.due(e[4]) for e in more), min((self.due(e[4]) for e in before), default=None)
            if was is None or first < was:
                if was is not None:
                    self.handle.deleteTimer(was)
                self.handle.registerTimer(first)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            yield Row(key=key[0], first_at=now[0], first_id=now[1], occurrences=now[2], last_at=now[3], resolved_at=None, expired_at=None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        box, mark = expiredTimerInfo.getExpiryTimeInMs() // self.width, timerValues.getCurrentWatermarkInMs()
        kept = []
        for episode in self.held(box):
            first_at, first_id, occurrences, last_at, resolved_at = episode
            if self.due(resolved_at) < mark:
                yield Row(key=key[0], first_at=first_at, first_id=first_id, occurrences=occurrences, last_at=last_at, resolved_at=resolved_at, expired_at=resolved_at + self.ttl)
            else:
                kept.append(episode)
        if kept:
            self.resolved.updateValue((box,), tuple(map(list, zip(*kept, strict=True))))
            self.handle.registerTimer(min(self.due(e[4]) for e in kept))
        else:
            self.resolved.removeKey((box,))

    def close(self) -> None:
        pass


def error_episodes(stream: DataFrame, key: Column, at: Column, tie: Column, resolves: Column, ttl: int | None = None) -> DataFrame:
    """key, first_at, first_id, occurrences, last_at, resolved_at (null while open), expired_at (null until then) of each
    episode: by key, first_at and first_id. With ttl the stream has a watermark on its column event_time; rows behind it are
    not counted. A null in resolves does not resolve."""
    rows = _keyed(stream, key.cast("string"), at, tie, resolves=F.coalesce(resolves, F.lit(False)))
    return rows.groupBy("key").transformWithState(Episodes(ttl), EPISODE, "Update", "None" if ttl is None else "EventTime")


class ChunksInOrder(StatefulProcessor):
    """A document's chunks as they arrive: chunk 0 or another job begins anew, each chunk with a section adds one, the last
    completes, an error fails. Nothing else is noticed: a late chunk 0 wipes what came before, an early last one
    completes, repeats count twice, and later chunks do not reopen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "job string, total long, received long, status string")
        self.sections = handle.getListState("sections", "place long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        job, total, received, status = self.job.get() if self.job.exists() else (None, None, 0, "processing")
        came: list[tuple] = []
        wiped = False
        for row in _in_order(rows):
            if row["failed"]:
                status = "failed"
                continue
            if row["place"] == 0 or job is None or job != row["job"]:
                job, total, received, came, wiped = row["job"], row["total"], 0, [], True
            if row["has_section"]:
                received += 1
                came.append((row["place"],))
            if not row["more"]:
                status = "completed"
        if wiped:
            self.sections.clear()
        if came:
            self.sections.appendList(came)
        self.job.update((job, total, received, status))
        arrived = [str(p) if p is not None else "-" for (p,) in self.sections.get()] if status == "completed" and self.sections.exists() else []
        yield Row(key=key[0], job=job, total=total, received=received, status=status, sections=",".join(arrived))

    def close(self) -> None:
        pass


def chunks_in_order(stream: DataFrame, key: Column, at: Column, tie: Column, job: Column, place: Column, total: Column, more: Column, has_section: Column, failed: Column) -> DataFrame:
    """key, job, total, received, status (processing, completed or failed), sections (their places as they arrived, once
    completed). A null place is not 0 and counts like any other ("-" among the places); a null job is always another one; a
    null in more ends, in has_section and failed it means no."""
    no = F.lit(False)
    columns = {"job": job.cast("string"), "place": place.cast("long"), "total": total.cast("long"), "more": F.coalesce(more, no), "has_section": F.coalesce(has_section, no), "failed": F.coalesce(failed, no)}
    rows = _keyed(stream, key.cast("string"), at, tie, **columns)
    return rows.groupBy("key").transformWithState(ChunksInOrder(), "key string, job string, total long, received long, status string, sections string", "Update", "None")


class DistinctChunks(StatefulProcessor):
    """Which of a document's chunks came, in whatever order and however often."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "place long", "there boolean")
        self.counts = handle.getValueState("counts", "received long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        received, total = self.counts.get() if self.counts.exists() else (0, 0)
        for row in rows:
            total = max(total, row["total"] or 0)
            if row["place"] is not None and not self.places.containsKey((row["place"],)):
                self.places.updateValue((row["place"],), (True,))
                received += 1
        self.counts.update((received, total))
        yield Row(key=key[0], received=received, complete=received == total)

    def close(self) -> None:
        pass


def assembled_chunks(stream: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """key, received, complete: a document is complete once each index is there, so order and repeats don't matter. A null
    index is no chunk; of differing totals the largest counts."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(index).cast("long").alias("place"), F.col(total).cast("long").alias("total"))
    made = rows.groupBy("key").transformWithState(DistinctChunks(), "key long, received long, complete boolean", "Update", "None")
    return made.withColumnRenamed("key", key)


class Payloads(StatefulProcessor):
    """The payload of a key, until it is replaced or a sweep finds it older than its time to live."""

    def __init__(self, ttl: int, every: int):
        self.ttl, self.every = ttl, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "stored_at long")

    def sweep(self, stored_at: int) -> int:
        """The first sweep at which it is older than ttl."""
        return ((stored_at + self.ttl) // self.every + 1) * self.every

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        stored = self.stored.get()
        now = before = None if stored is None else stored[0]
        for row in _in_order(rows):
            at = row[AT] or 0
            if now is not None:
                swept = at >= self.sweep(now)
                yield Row(key=key[0], stored_at=now, ended_at=self.sweep(now) if swept else at, swept=swept)
            now = at
        if before != now:
            self.stored.update((now,))
        was, due = None if before is None else self.sweep(before), self.sweep(now)
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was // 1000)
            self.handle.registerTimer(due // 1000)
        yield Row(key=key[0], stored_at=now, ended_at=None, swept=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        stored = self.stored.get()
        if stored is not None:
            stored_at = stored[0]
            if self.sweep(stored_at) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.stored.clear()
                yield Row(key=key[0], stored_at=stored_at, ended_at=self.sweep(stored_at), swept=True)

    def close(self) -> None:
        pass


def swept_payloads(stream: DataFrame, key: Column, at: Column, tie: Column, ttl: int, every: int) -> DataFrame:
    """key, stored_at, ended_at (null while it is there), swept (false if another payload of the key replaced it): sweeps
    are at whole multiples of every. The stream has a watermark on its column event_time; a sweep happens when the
    watermark is past it, or when the key's next payload is. Payloads stored at one time are one for update's sake."""
    rows = _keyed(stream, key.cast("string"), at, tie)
    return rows.groupBy("key").transformWithState(Payloads(ttl, every), "key string, stored_at long, ended_at long, swept boolean", "Update", "EventTime")
