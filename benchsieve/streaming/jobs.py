"""Roll-ups of job events; each works on a table and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from benchsieve.sources.schemas import JOB_EVENT

TERMINAL = ("done", "error")
FILE_STATUS = {"file_started": "processing", "file_done": "completed", "file_delay": "waiting"}
CHUNK_STATUS = {
    "chunk_ready": "ready",
    "chunk_forwarding": "forwarding",
    "chunk_forwarded": "forwarded",
    "chunk_forward_failed": "failed",
}


def read_events(
    spark: SparkSession, path: str, schema: StructType = JOB_EVENT, files_per_batch: int = 1000
) -> DataFrame:
    """A stream of job events from JSON files."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def drop_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events delivered again within the delay; ``ts`` must be a timestamp."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _when_type(*types: str) -> Column:
    """Order of an event of the given types; null for others, which are then ignored."""
    return F.when(F.col("type").isin(*types), F.struct("ts", "event_id"))


def job_progress(events: DataFrame) -> DataFrame:
    """Latest position, results so far and percent per job."""
    files = tuple(FILE_STATUS)
    shown = _when_type("progress", *files)
    position = F.when(F.col("type") == "progress", F.col("prompt_index")).otherwise(
        F.col("processed_prompts")
    )
    rolled = events.groupBy("job_id").agg(
        F.max_by(position, shown).alias("current"),
        F.max_by("total", shown).alias("total"),
        F.count_if(F.col("type") == "progress").alias("result_count"),
        F.count_if(F.col("type") == "model_failed").alias("failed_count"),
    )
    percent = F.round(F.try_divide(F.col("current") * 100, F.col("total"))).cast("bigint")
    return rolled.withColumn("percent", F.coalesce(percent, F.lit(0).cast("bigint")))


def job_status(events: DataFrame) -> DataFrame:
    """running, done or error per job, from its first terminal event."""
    ended = _when_type(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.coalesce(F.min_by("type", ended), F.lit("running")).alias("status"),
        F.count(F.lit(1)).alias("event_count"),
    )


def failures(events: DataFrame) -> DataFrame:
    """Events of models that gave no response."""
    return events.where(F.col("type") == "model_failed")


def status_of(mapping: dict[str, str]) -> Column:
    text = F.lit(None).cast("string")
    for event, status in mapping.items():
        text = F.when(F.col("type") == event, status).otherwise(text)
    return text


def _last_given(*columns: str) -> list[Column]:
    """The newest value of each column, passing over events that lack it."""
    return [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
        for c in columns
    ]


def job_starts(events: DataFrame) -> DataFrame:
    """What the first ``started`` event of each job announces."""
    announced = ("total", "total_chunks", "auto_forward", "prompt_complexity", "use_case")
    order = F.struct("ts", "event_id")
    return (
        events.where(F.col("type") == "started")
        .groupBy("job_id")
        .agg(*[F.min_by(c, order).alias(c) for c in announced])
    )


def file_lifecycle(events: DataFrame) -> DataFrame:
    """Latest status per file of a job, with its name and how far the job is.

    A delay and the file after it are shown only while the file's latest event is the delay.
    """
    order = F.struct("ts", "event_id")
    latest = ("processed_prompts", "total", "delay_ms", "next_file_index")
    return (
        events.where(F.col("type").isin(*FILE_STATUS))
        .groupBy("job_id", "file_index")
        .agg(
            F.max_by(status_of(FILE_STATUS), order).alias("status"),
            *[F.max_by(c, order).alias(c) for c in latest],
            *_last_given("file_name", "total_files"),
        )
    )


def chunk_lifecycle(events: DataFrame) -> DataFrame:
    """Latest status per chunk of a job, with what its events have said so far."""
    order = F.struct("ts", "event_id")
    told = ("file_name", "chunk_size", "forward_status", "training_job_id", "message")
    return (
        events.where(F.col("type").isin(*CHUNK_STATUS))
        .groupBy("job_id", "chunk_index")
        .agg(
            F.max_by(status_of(CHUNK_STATUS), order).alias("status"),
            F.count_if(F.col("type") == "chunk_ready").alias("ready_count"),
            *_last_given(*told),
        )
    )


def until_terminal(events: DataFrame) -> DataFrame:
    """Events of a table up to and with the first terminal event of their job."""
    ends = events.groupBy("job_id").agg(F.min(_when_type(*TERMINAL)).alias("_end"))
    order = F.struct("ts", "event_id")
    return (
        events.join(ends, "job_id")
        .where(F.col("_end").isNull() | (order <= F.col("_end")))
        .drop("_end")
    )


def write_updates(
    rolled: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger
) -> None:
    """Write each batch of changed rows to its own folder, and wait for the end.

    A batch that runs again after a failure replaces its folder.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = (
        rolled.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(store)
        .start()
    )
    run.awaitTermination()


def latest_rows(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row per key of a folder of updates."""
    columns = [f.name for f in schema]
    stored = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return newest.select("row.*")


def forward_chunks(
    chunks: DataFrame,
    to_benchmark: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> None:
    """Turn each batch of finished chunk rows into benchmark rows.

    ``to_benchmark`` maps prompt rows to benchmark rows, for example by joining a
    response log.
    """

    def store(batch: DataFrame, number: int) -> None:
        to_benchmark(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = (
        chunks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    run.awaitTermination()
