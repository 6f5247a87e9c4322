"""Summaries per model, slice and complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.distribution import group_stats, level_stats
from benchsieve.functions.durable import settle
from benchsieve.functions.numbers import round_to

MODEL = ["model_id", "provider"]
SLICE = ["use_case", "prompt_complexity", "clarity"]
PROFILE = ["provider", "model_id", "prompt_complexity"]
METRICS = ["accuracy_score", "cost", "latency_ms"]

SUMMARY = {
    "sample_count": ("accuracy_score", "count"),
    "avg_accuracy": ("accuracy_score", "mean"),
    "median_accuracy": ("accuracy_score", "median"),
    "median_cost": ("cost", "median"),
    "median_latency_ms": ("latency_ms", "median"),
}
EXTENDED_SUMMARY = {
    **SUMMARY,
    "avg_cost": ("cost", "mean"),
    "avg_latency_ms": ("latency_ms", "mean"),
}


def summary_order() -> list[Column]:
    """Best accuracy first, then support, cost and latency; names make it total."""
    return [
        F.desc("avg_accuracy"),
        F.desc("sample_count"),
        F.asc("median_cost"),
        F.asc("median_latency_ms"),
        F.asc("model_id"),
        F.asc("provider"),
    ]


def model_summary(
    bench: DataFrame, min_samples: int = 1, keys: list[str] | None = None
) -> DataFrame:
    """Count, mean and median accuracy, median cost and latency per model and provider."""
    keys = keys or MODEL
    return group_stats(_slim(bench, keys), keys, SUMMARY).where(
        F.col("sample_count") >= min_samples
    )


def extended_summary(bench: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The summary with mean cost and latency; a null provider is a group of its own."""
    keys = keys or MODEL
    return group_stats(_slim(bench, keys), keys, EXTENDED_SUMMARY)


def _slim(bench: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and metrics of clean rows, written once since the summary reads them twice."""
    return settle(bench.select(*keys, *METRICS))


def _tiers() -> list[Column]:
    """The slice of each of the three tiers that a slice belongs to."""
    complexity, clarity = F.col("prompt_complexity"), F.col("clarity")
    every = F.lit(policy.ANY)

    def tier(number: int, slice_complexity: Column, slice_clarity: Column) -> Column:
        return F.struct(
            F.lit(number).alias("tier"),
            F.col("use_case").alias("use_case"),
            slice_complexity.alias("slice_complexity"),
            slice_clarity.alias("slice_clarity"),
            *MODEL,
        )

    return [tier(0, complexity, clarity), tier(1, complexity, every), tier(2, every, every)]


TIER_SLICE = ["tier", "use_case", "slice_complexity", "slice_clarity"]


def tier_summary(bench: DataFrame) -> DataFrame:
    """Model summaries of every slice of every tier, with the rows of the slice.

    ``slice_row_count`` also counts the rows of models with little support.
    """
    rows = _slim(bench, [*SLICE, *MODEL])
    summary = level_stats(rows, [*SLICE, *MODEL], _tiers(), [*TIER_SLICE, *MODEL], SUMMARY)
    in_slice = Window.partitionBy(*TIER_SLICE)
    return summary.withColumn("slice_row_count", F.sum("sample_count").over(in_slice))


def supported_slices(bench: DataFrame, min_samples: int) -> DataFrame:
    """Summaries of models with enough rows, for every slice of every tier."""
    return tier_summary(bench).where(F.col("sample_count") >= min_samples)


def tier_summary_by_model_support(bench: DataFrame, min_samples: int) -> DataFrame:
    """The variant where support counts all rows of a model id, whatever its provider.

    Small provider groups of a supported model stay, and the slice counts only
    rows of supported models.
    """
    rows = _slim(bench, [*SLICE, *MODEL])
    summary = level_stats(rows, [*SLICE, *MODEL], _tiers(), [*TIER_SLICE, *MODEL], EXTENDED_SUMMARY)
    of_model = Window.partitionBy(*TIER_SLICE, "model_id")
    in_slice = Window.partitionBy(*TIER_SLICE)
    return (
        summary.withColumn("_support", F.sum("sample_count").over(of_model))
        .where(F.col("_support") >= min_samples)
        .drop("_support")
        .withColumn("slice_row_count", F.sum("sample_count").over(in_slice))
    )


def profiles(rows: DataFrame) -> DataFrame:
    """Means, count, median and sample deviation per provider, model and complexity.

    Rows without a provider form no profile. One row has deviation 0.
    """
    known = settle(_profiled(rows))
    return _detail_profiles(known)


def overall_profiles(rows: DataFrame) -> DataFrame:
    return _overall_profiles(_profiled(rows))


def _profiled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("provider").isNotNull()).select(
        *PROFILE, "accuracy_score", "cost", "latency_ms", "tokens"
    )


def _detail_profiles(known: DataFrame) -> DataFrame:
    columns = {
        "avg_accuracy": ("accuracy_score", "mean"),
        "avg_cost": ("cost", "mean"),
        "avg_latency_ms": ("latency_ms", "mean"),
        "avg_tokens": ("tokens", "mean"),
        "sample_count": ("accuracy_score", "count"),
        "median_accuracy": ("accuracy_score", "median"),
    }
    spread = F.coalesce(F.stddev_samp("accuracy_score"), F.lit(0.0))
    return group_stats(known, PROFILE, columns, {"std_accuracy": spread})


def _overall_profiles(known: DataFrame) -> DataFrame:
    return known.groupBy("provider", "model_id").agg(
        F.avg("accuracy_score").alias("avg_accuracy"),
        F.avg("cost").alias("avg_cost"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count("accuracy_score").alias("sample_count"),
    )


def rounded_profiles(profile_rows: DataFrame) -> DataFrame:
    """Profile numbers as they are published: scores to 2 digits, cost 6, the rest 1."""
    digits = {
        "avg_accuracy": 2,
        "avg_cost": 6,
        "avg_latency_ms": 1,
        "avg_tokens": 1,
        "median_accuracy": 2,
        "std_accuracy": 2,
    }
    return profile_rows.withColumns(
        {c: round_to(F.col(c), d) for c, d in digits.items() if c in profile_rows.columns}
    )


def nested_profiles(rows: DataFrame) -> DataFrame:
    """One document per model: overall numbers and a map by complexity.

    Numbers per complexity come from the last provider in the alphabet, the name
    and overall numbers from the first. A model has one entry per complexity
    label, so the collected list is short.
    """
    known = settle(_profiled(rows))
    detail = rounded_profiles(_detail_profiles(known))
    overall = rounded_profiles(_overall_profiles(known))
    numbers = [
        "avg_accuracy",
        "avg_cost",
        "avg_latency_ms",
        "avg_tokens",
        "sample_count",
        "median_accuracy",
        "std_accuracy",
    ]
    by_complexity = (
        detail.groupBy("model_id", "prompt_complexity")
        .agg(F.max_by(F.struct(*numbers), "provider").alias("stats"))
        .groupBy("model_id")
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("prompt_complexity", "stats")))
            ).alias("by_complexity")
        )
    )
    first = overall.groupBy("model_id").agg(
        F.min("provider").alias("provider"),
        F.min_by(
            F.struct("avg_accuracy", "avg_cost", "avg_latency_ms", "sample_count"), "provider"
        ).alias("overall"),
    )
    return first.join(by_complexity, ["model_id"]).select(
        "model_id", "provider", "overall", "by_complexity"
    )


def top_by_complexity(profile_rows: DataFrame, n: int = 5) -> DataFrame:
    best = Window.partitionBy("prompt_complexity").orderBy(
        F.desc("avg_accuracy"), F.asc("provider"), F.asc("model_id")
    )
    return profile_rows.withColumn("rank", F.row_number().over(best).cast("bigint")).where(
        F.col("rank") <= n
    )


def options_catalog(bench: DataFrame, min_samples: int = policy.Policy.min_samples) -> DataFrame:
    """Rounded summary over all use cases, with the use cases each model id was run for."""
    rows = _slim(bench, [*MODEL, "use_case"])
    summary = group_stats(rows, MODEL, SUMMARY).where(F.col("sample_count") >= min_samples)
    used = (
        rows.select("model_id", "use_case")
        .distinct()
        .groupBy("model_id")
        .agg(F.sort_array(F.collect_list("use_case")).alias("use_cases"))
    )
    return summary.join(used, ["model_id"]).select(
        "model_id",
        "provider",
        round_to(F.col("avg_accuracy"), 2).alias("avg_accuracy"),
        round_to(F.col("median_cost"), 6).alias("median_cost"),
        round_to(F.col("median_latency_ms"), 1).alias("median_latency_ms"),
        "sample_count",
        "use_cases",
    )


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"))


def smallest_class(rows: DataFrame, label: str) -> DataFrame:
    return class_distribution(rows, label).agg(F.min("row_count").alias("min_class_count"))


def dataset_counts(rows: DataFrame) -> DataFrame:
    """Rows, models and providers; names are made distinct before they are counted."""
    pairs = rows.groupBy("model_id", "provider").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.sum("n").alias("row_count"),
        F.countDistinct("model_id").alias("model_count"),
        F.countDistinct("provider").alias("provider_count"),
    )


def provider_checks(checks: DataFrame) -> DataFrame:
    """Passed and total check rows per source; ``checks`` has a boolean ``passed``."""
    return checks.groupBy("source").agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")
    )


def provider_rank(provider: Column) -> Column:
    """Sort key of a provider in check reports; unknown providers come last."""
    order = F.array(*[F.lit(p) for p in policy.PROVIDER_ORDER])
    position = F.array_position(order, provider)
    return F.when(position > 0, position - 1).otherwise(99).cast("bigint")


def mean_summary(bench: DataFrame) -> DataFrame:
    """Mean metrics per model of a (use case, complexity) slice; one provider name is kept."""
    return bench.groupBy("use_case", "prompt_complexity", "model_id").agg(
        F.min("provider").alias("provider"),
        F.avg("accuracy_score").alias("avg_accuracy"),
        F.avg("cost").alias("avg_cost"),
        F.avg("latency_ms").alias("avg_latency"),
    )
