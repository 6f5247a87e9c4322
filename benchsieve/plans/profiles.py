"""Profiles from phase files, and the composite recommendation built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.operators import aggregate, rank
from benchsieve.operators.clean import clean_for_profiles
from benchsieve.policy import PROFILE_MIN_SAMPLES, PROFILE_TOP_N, Weights
from benchsieve.sources.readers import combine_phases


def build_profiles(phases: list[DataFrame]) -> DataFrame:
    return aggregate.nested_profiles(clean_for_profiles(combine_phases(phases)))


def flatten_profiles(documents: DataFrame) -> DataFrame:
    """Profile documents as one row per model and complexity."""
    return documents.select(
        "model_id",
        "provider",
        F.explode("by_complexity").alias("prompt_complexity", "stats"),
    ).select("model_id", "provider", "prompt_complexity", "stats.*")


def recommend_by_profile(
    requests: DataFrame,
    flat_profiles: DataFrame,
    weights: Weights = Weights(),
    top_n: int = PROFILE_TOP_N,
    min_samples: int = PROFILE_MIN_SAMPLES,
) -> DataFrame:
    """Top profiles and the delta for each request with ``complexity`` and ``current_model``."""
    ranked = settle(rank.composite_ranking(flat_profiles, weights, min_samples))
    compared = rank.profile_deltas(requests, ranked, flat_profiles)
    top = (
        rank.top_recommendations(ranked, top_n)
        .groupBy(F.col("prompt_complexity").alias("complexity"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rank",
                        "model_id",
                        "provider",
                        "avg_accuracy",
                        "avg_cost",
                        "avg_latency_ms",
                        "composite_score",
                        "sample_count",
                    )
                )
            ).alias("recommendations")
        )
    )
    joined = compared.join(settle(top), "complexity", "left")
    return joined.withColumn(
        "error",
        F.when(
            F.col("recommendations").isNull(),
            F.concat(
                F.lit("No model data available for '"), F.col("complexity"), F.lit("' complexity")
            ),
        ),
    )
