"""Sinks: benchmark tables, prompt logs, chunk exports, labels and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENCHMARK_PARTITIONS = ("use_case", "prompt_complexity")
BENCHMARK_ORDER = ("clarity", "model_id")
# Quotes are doubled and outer white space stays, so that texts come back unchanged.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def append_benchmark(rows: DataFrame, path: str) -> None:
    """Append rows partitioned by use case and complexity, clustered by clarity and model.

    One task could hold a whole hot slice, so rows are spread before the write
    and files are bounded in rows. Within a file equal values stand together, so that
    filters on them skip its row groups and pages by their bounds.
    """
    order = [c for c in BENCHMARK_ORDER if c in rows.columns]
    (
        rows.hint("rebalance", *BENCHMARK_PARTITIONS)
        .sortWithinPartitions(*BENCHMARK_PARTITIONS, *order)
        .write.mode("append")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*BENCHMARK_PARTITIONS)
        .parquet(path)
    )


def append_prompt_logs(rows: DataFrame, path: str) -> None:
    rows.select("prompt", "use_case", "clarity").write.mode("append").parquet(path)


def write_chunks(chunked: DataFrame, path: str, folder_per_chunk: bool = False) -> None:
    """Export (chunk, prompt, clarity) as CSV, the chunks in order and many to a file.

    With ``folder_per_chunk`` each chunk has a folder ``chunk=N`` and no chunk column.
    """
    rows = chunked.select("chunk", "prompt", "clarity")
    if folder_per_chunk:
        writer = rows.repartition("chunk").write.partitionBy("chunk")
    else:
        writer = rows.repartitionByRange("chunk").sortWithinPartitions("chunk").write
    writer.mode("overwrite").options(**CSV).csv(path)


def write_prompts(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Prompt files as CSV with the columns in the given order."""
    rows.select(*columns).write.mode("overwrite").options(**CSV).csv(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def append_relabelled(rows: DataFrame, path: str, labeller: str) -> None:
    """Append labels with their origin, the former label and the reason."""
    (
        rows.select(
            "prompt",
            "use_case",
            "prompt_complexity",
            "clarity",
            "old_prompt_complexity",
            "complexity_reason",
            F.lit(labeller).alias("label_source"),
        )
        .write.mode("append")
        .parquet(path)
    )
