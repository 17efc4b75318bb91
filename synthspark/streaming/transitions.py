"""Illegal moves between job states, found while events stream in, late and out of order."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from synthspark.operators.history import TRANSITIONS
from synthspark.streaming.jobs import _folder, run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _allowed(before: str | None, after: str | None) -> bool:
    return after == "queued" if before is None else after in TRANSITIONS.get(before, [])


# Events in one stored piece.
PIECE = 5_000


class Moves(StatefulProcessor):
    """Events of a job wait until the watermark has passed them, then move the job in order of time and id.

    State of a job: its last event, and the waiting events in pieces: what one batch brought, ordered and cut at ``PIECE``
    events. One timer stands for the earliest of them, and when it expires, all that the watermark has passed move at once.
    So calls to the state follow the jobs and pieces of a batch, not its events. An event that comes again while it waits
    counts once; one that comes after the watermark has passed its time is left out. With ``idle_ms`` a job without events
    for longer than that is forgotten.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Pieces: number in order of arrival and first millisecond of each. Due: when the timer of the waiting events expires.
        self.job = handle.getValueState("job", "status string, at long, due long, pieces string")
        self.waiting = handle.getMapState("waiting", "piece long", "events string")

    def _job(self) -> tuple:
        kept = self.job.get()
        return (kept[0], kept[1], kept[2], json.loads(kept[3])) if kept else (None, None, None, [])

    def _store(self, status: str | None, at: int | None, due: int | None, pieces: list) -> None:
        if at is None and not pieces:
            self.job.clear()
            return
        first = min((ms for _, ms in pieces), default=None)
        if first is not None and (due is None or first + 1 < due):
            if due is not None:
                self.handle.deleteTimer(due)
            # One more than the event's own time: then no event of that millisecond can follow.
            due = first + 1
            self.handle.registerTimer(due)
        self.job.update((status, at, due, json.dumps(pieces)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh: dict[tuple, str] = {}
        for frame in rows:
            for number, status, at in zip(frame["event_id"].tolist(), frame["status"].tolist(), frame["at"].tolist()):
                if at // 1000 >= watermark:
                    fresh[(int(at), number)] = status
        if fresh:
            status, at, due, pieces = self._job()
            number = max((n for n, _ in pieces), default=-1)
            events = sorted(fresh)
            for start in range(0, len(events), PIECE):
                part = events[start : start + PIECE]
                number += 1
                self.waiting.updateValue((number,), (json.dumps([[*e, fresh[e]] for e in part]),))
                pieces.append([number, part[0][0] // 1000])
            self._store(status, at, due, pieces)
        yield from ()

    def _passed(self, pieces: list, watermark: int, left: list) -> Iterator[tuple]:
        """Waiting events before the watermark by time and id, each once; pieces that still wait are added to ``left``.

        A piece is read when the events before it are through. Of an event that came twice the first counts.
        """
        heap: list[tuple] = []
        known = None
        ordered = sorted(pieces, key=lambda p: p[1])
        for place, (number, first) in enumerate(ordered):
            if first >= watermark:
                left.append([number, first])
                continue
            events = json.loads(self.waiting.getValue((number,))[0])
            later = [e for e in events if e[0] // 1000 >= watermark]
            if later:
                self.waiting.updateValue((number,), (json.dumps(later),))
                left.append([number, later[0][0] // 1000])
            else:
                self.waiting.removeKey((number,))
            for at, event, status in events[: len(events) - len(later)]:
                heapq.heappush(heap, (at, event, number, status))
            until = ordered[place + 1][1] if place + 1 < len(ordered) else watermark
            while heap and heap[0][0] // 1000 < until:
                at, event, _, status = heapq.heappop(heap)
                if (at, event) != known:
                    known = (at, event)
                    yield at, event, status
        while heap:
            at, event, _, status = heapq.heappop(heap)
            if (at, event) != known:
                known = (at, event)
                yield at, event, status

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        before, last, due, pieces = self._job()
        found = last
        wrong: list[tuple] = []
        left: list = []
        for at, number, after in self._passed(pieces, watermark, left):
            if self._idle(last, at // 1000):
                before = None
            if not _allowed(before, after):
                wrong.append((number, key[0], before, after))
            before, last = after, at
            if len(wrong) == PIECE:
                yield _moves(wrong)
                wrong = []
        moved = last != found
        # An event at the watermark itself may still come.
        if self._idle(last, watermark):
            before, last = None, None
        elif moved and self.idle_ms is not None:
            self.handle.registerTimer(last // 1000 + 1 + self.idle_ms)
        if moved or last != found or pieces != left:
            self._store(before, last, due if due is not None and due > watermark else None, left)
        if wrong:
            yield _moves(wrong)

    def _idle(self, last: int | None, ms: int) -> bool:
        return last is not None and self.idle_ms is not None and last // 1000 + self.idle_ms < ms


def _moves(wrong: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(wrong, columns=["event_id", "job_id", "previous_status", "status"])


def stream_transitions(stream: DataFrame, root: str, delay: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """``(event_id, job_id, previous_status, status)`` of moves that are not allowed, of events the watermark has passed.

    Events ``(event_id, job_id, status, ts)`` may come up to ``delay`` behind the newest one, in any order and more than
    once. Called again with the same folder it goes on from the checkpoint. Rows without job, id or time move nothing, but their
    time moves the watermark. State lies in the embedded store on disk that timers need; the session's own choice is put back.
    """
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(name, stream.schema[name].dataType) for name in ("event_id", "job_id")])
    schema = schema.add("previous_status", "string").add("status", "string")
    events = stream.select("event_id", "job_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    # One condition that also reads the time: others are pushed below the watermark, which would then not see these rows.
    named = F.when(F.col("event_id").isNotNull() & F.col("job_id").isNotNull(), F.col("ts")).isNotNull()
    whole = events.where(named).withColumn("at", F.unix_micros("ts"))
    moved = whole.groupBy("job_id").transformWithStateInPandas(Moves(idle_ms), schema, "append", "EventTime")
    target = _folder(root, "transitions")
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run_available(moved.writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(root, "_progress_transitions")))
    finally:
        if own is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, own)
    return spark.read.schema(schema).parquet(target)
