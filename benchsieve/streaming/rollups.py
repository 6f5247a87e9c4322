"""Roll-ups of job events in parts that merge, so that a stream's state stays bounded.

A roll-up is counts and first or last values. The stream keeps them per key and window of event
time; a window leaves the state once the watermark has passed it. Each part holds the order of
its value, so parts of several windows merge into what one pass over all events would give.

Events that arrive again within the delay count once. Events later than the delay, measured at
the newest event so far, are dropped; no window is opened for them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.streaming import jobs
from benchsieve.streaming.store import UpdateStore

WINDOW = "window"


@dataclass(frozen=True)
class Part:
    """``count`` of rows where ``order`` is true, or the ``first`` or ``last`` value by ``order``.

    Rows whose order is null have no value to give.
    """

    kind: str
    order: Column
    value: Column | None = None

    def of_rows(self) -> Column:
        if self.kind == "count":
            return F.count_if(self.order)
        held = F.when(self.order.isNotNull(), F.struct(self.order.alias("at"), self.value.alias("value")))
        return F.max(held) if self.kind == "last" else F.min(held)

    def of_parts(self, name: str) -> Column:
        return {"count": F.sum, "last": F.max, "first": F.min}[self.kind](name)

    def finished(self, name: str) -> Column:
        return F.col(name) if self.kind == "count" else F.col(f"{name}.value")


def _order(condition: Column | None = None) -> Column:
    order = F.struct("ts", "event_id")
    return order if condition is None else F.when(condition, order)


@dataclass(frozen=True)
class RollUp:
    """Parts per key over events of some types; ``then`` turns finished parts into the result."""

    keys: tuple[str, ...]
    parts: Callable[[], dict[str, Part]]
    types: tuple[str, ...] = ()
    then: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def partial(self, events: DataFrame, *more: Column) -> DataFrame:
        """Parts per key, and per ``more``, of a table or a stream."""
        rows = events.where(F.col("type").isin(*self.types)) if self.types else events
        return rows.groupBy(*self.keys, *more).agg(*[p.of_rows().alias(n) for n, p in self.parts().items()])

    def merge(self, partial: DataFrame) -> DataFrame:
        merged = partial.groupBy(*self.keys).agg(*[p.of_parts(n).alias(n) for n, p in self.parts().items()])
        return self.then(merged.select(*self.keys, *[p.finished(n).alias(n) for n, p in self.parts().items()]))


def _progress_parts() -> dict[str, Part]:
    shown = _order(F.col("type").isin("progress", *jobs.FILE_STATUS))
    position = F.when(F.col("type") == "progress", F.col("prompt_index")).otherwise(F.col("processed_prompts"))
    return {
        "current": Part("last", shown, position),
        "total": Part("last", shown, F.col("total")),
        "result_count": Part("count", F.col("type") == "progress"),
        "failed_count": Part("count", F.col("type") == "model_failed"),
    }


def _with_percent(rows: DataFrame) -> DataFrame:
    percent = F.round(F.try_divide(F.col("current") * 100, F.col("total"))).cast("bigint")
    return rows.withColumn("percent", F.coalesce(percent, F.lit(0).cast("bigint")))


def _status_parts() -> dict[str, Part]:
    return {
        "status": Part("first", _order(F.col("type").isin(*jobs.TERMINAL)), F.col("type")),
        "event_count": Part("count", F.lit(True)),
    }


def _running(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.coalesce("status", F.lit("running")))


def _given(*columns: str) -> dict[str, Part]:
    """The newest value of each column, passing over events that lack it."""
    return {c: Part("last", _order(F.col(c).isNotNull()), F.col(c)) for c in columns}


def _file_parts() -> dict[str, Part]:
    latest = ("processed_prompts", "total", "delay_ms", "next_file_index")
    return (
        {"status": Part("last", _order(), jobs.status_of(jobs.FILE_STATUS))}
        | {c: Part("last", _order(), F.col(c)) for c in latest}
        | _given("file_name", "total_files")
    )


def _chunk_parts() -> dict[str, Part]:
    return {
        "status": Part("last", _order(), jobs.status_of(jobs.CHUNK_STATUS)),
        "ready_count": Part("count", F.col("type") == "chunk_ready"),
    } | _given("file_name", "chunk_size", "forward_status", "training_job_id", "message")


def _start_parts() -> dict[str, Part]:
    announced = ("total", "total_chunks", "auto_forward", "prompt_complexity", "use_case")
    return {c: Part("first", _order(), F.col(c)) for c in announced}


JOB_PROGRESS = RollUp(("job_id",), _progress_parts, then=_with_percent)
JOB_STATUS = RollUp(("job_id",), _status_parts, then=_running)
JOB_STARTS = RollUp(("job_id",), _start_parts, ("started",))
FILE_LIFECYCLE = RollUp(("job_id", "file_index"), _file_parts, tuple(jobs.FILE_STATUS))
CHUNK_LIFECYCLE = RollUp(("job_id", "chunk_index"), _chunk_parts, tuple(jobs.CHUNK_STATUS))


def windowed(events: DataFrame, roll_up: RollUp, delay: str, span: str) -> DataFrame:
    """A stream of parts per key and window of ``span``; ``ts`` must be a timestamp."""
    return roll_up.partial(jobs.drop_repeats(events, delay), F.window("ts", span).alias(WINDOW))


class BoundedRollUp:
    """A roll-up of an event stream, kept in an update store under ``path``."""

    def __init__(self, events: DataFrame, roll_up: RollUp, path: str, delay: str = "1 hour", span: str = "1 day", **store):
        self.roll_up = roll_up
        self.stream = windowed(events, roll_up, delay, span)
        keys = [*roll_up.keys, WINDOW]
        self.store = UpdateStore(events.sparkSession, f"{path}/rows", self.stream.schema, keys, **store)
        self.checkpoint = f"{path}/checkpoint"

    def run(self, **trigger) -> list[dict]:
        """Take in what has arrived; returns the reports of the batches."""
        return self.store.write_stream(self.stream, self.checkpoint, **trigger)

    def rows(self) -> DataFrame:
        """The roll-up as of the last batch."""
        return self.roll_up.merge(self.store.read())
