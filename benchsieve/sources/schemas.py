"""Explicit schemas of the tables and files."""

from __future__ import annotations

from pyspark.sql import types as T

BENCHMARK_CSV = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("use_case", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("prompt_complexity", T.StringType()),
        T.StructField("prompt_quality_score", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("accuracy_score", T.StringType()),
        T.StructField("cost", T.StringType()),
        T.StructField("tokens", T.StringType()),
        T.StructField("latency_ms", T.StringType()),
        T.StructField("clarity", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("avg_accuracy", T.DoubleType()),
        T.StructField("avg_cost", T.DoubleType()),
        T.StructField("avg_latency_ms", T.DoubleType()),
        T.StructField("sample_count", T.LongType()),
    ]
)

COMPLEXITY_METRICS = T.StructType(
    [
        T.StructField("avg_accuracy", T.DoubleType()),
        T.StructField("avg_cost", T.DoubleType()),
        T.StructField("avg_latency_ms", T.DoubleType()),
        T.StructField("avg_tokens", T.DoubleType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("median_accuracy", T.DoubleType()),
        T.StructField("std_accuracy", T.DoubleType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("overall", METRICS),
        T.StructField("by_complexity", T.MapType(T.StringType(), COMPLEXITY_METRICS)),
    ]
)

JUDGE_SCORES = "array<struct<model_id:string,accuracy_score:string>>"

JOB_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("prompt_index", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("prompt_complexity", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_index", T.LongType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("processed_prompts", T.LongType()),
        T.StructField("forward_status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("delay_ms", T.LongType()),
        T.StructField("next_file_index", T.LongType()),
        T.StructField("chunk_size", T.LongType()),
        T.StructField("training_job_id", T.StringType()),
        T.StructField("total_chunks", T.LongType()),
        T.StructField("auto_forward", T.BooleanType()),
        T.StructField("use_case", T.StringType()),
    ]
)
