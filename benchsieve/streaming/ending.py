"""The end of a job's stream: nothing is passed on after its first terminal event.

Each job that has ended keeps the place of its end, one small value, for as long as events may
still come. Events of that time that stand before the end pass, later ones are dropped; the
value is removed when the watermark is ``keep`` beyond the job's end or last event. Events older
than the watermark are dropped, so a late one cannot open an ended job again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from benchsieve.streaming.jobs import TERMINAL

# Executors get the processor with the tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH, _TICK = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


def _place(at: int, event_id: int | None) -> tuple[int, bool, int]:
    """The order of events; one without id is the last of its time."""
    return at, event_id is None, event_id or 0


class _UntilEnd(StatefulProcessor):
    """Works on rows: a job has few of a micro-batch, for which a pandas table costs more than they do."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "ts long, event_id long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        late_before = timerValues.getCurrentWatermarkInMs() * 1000
        # One job's rows of one micro-batch, whose size the source's option bounds.
        held, first, newest = [], None, None
        for r in rows:
            if r.ts is None:
                continue
            at = ((r.ts if r.ts.tzinfo else r.ts.replace(tzinfo=timezone.utc)) - _EPOCH) // _TICK
            if at < late_before:
                continue
            held.append((at, r))
            newest = at if newest is None else max(newest, at)
            if r.type in TERMINAL and (first is None or _place(at, r.event_id) < _place(*first)):
                first = at, r.event_id
        if not held:
            return
        known = self.end.get()
        end = known
        if first is not None and (known is None or _place(*first) < _place(known[0], known[1])):
            end = (*first, known[2] if known is not None else 0)
        if end is not None:
            timer = max(end[0], newest) // 1000 + self.keep_ms
            if timer > end[2]:
                if end[2]:
                    self.handle.deleteTimer(end[2])
                self.handle.registerTimer(timer)
                end = (end[0], end[1], timer)
            if end is not known:
                self.end.update(end)
        for at, r in held:
            if end is None or at < end[0] or (at == end[0] and None not in (r.event_id, end[1]) and r.event_id <= end[1]):
                yield r

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.end.clear()
        return iter(())

    def close(self) -> None:
        pass


def until_end(events: DataFrame, delay: str = "1 hour", keep_hours: float = 24) -> DataFrame:
    """Events of a stream up to and with the first terminal event of their job.

    ``ts`` must be a timestamp. The stream is to be written in append mode, and the session's
    state store provider must be ``PROVIDER``.
    """
    marked = events.withWatermark("ts", delay)
    return marked.groupBy("job_id").transformWithState(
        _UntilEnd(int(keep_hours * 3_600_000)), events.schema, "Append", "EventTime"
    )
