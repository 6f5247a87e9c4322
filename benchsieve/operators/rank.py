"""Ranking models of a slice, comparing with the current model, deciding on a switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.durable import settle
from benchsieve.functions.numbers import (
    floored_percent_change,
    lower_is_better,
    percent_change,
    round_to,
)
from benchsieve.operators.aggregate import summary_order
from benchsieve.policy import Policy, Weights

STATS = [
    "model_id",
    "provider",
    "sample_count",
    "avg_accuracy",
    "median_accuracy",
    "median_cost",
    "median_latency_ms",
]


def rounded_stats() -> Column:
    """The published numbers of a model as a struct."""
    return F.struct(
        "model_id",
        "provider",
        F.col("sample_count").cast("bigint").alias("sample_count"),
        round_to(F.col("avg_accuracy"), 2).alias("avg_accuracy"),
        round_to(F.col("median_accuracy"), 2).alias("median_accuracy"),
        round_to(F.col("median_cost"), 6).alias("median_cost"),
        round_to(F.col("median_latency_ms"), 1).alias("median_latency_ms"),
    )


def value_scores(
    summary: DataFrame, slice_keys: list[str], rules: Policy = Policy()
) -> DataFrame:
    """Mark the accuracy shortlist of each slice and score its models by value.

    Cost and latency are normalised within the shortlist; other models have no
    score.
    """
    in_slice = Window.partitionBy(*slice_keys)
    listed = F.col("in_shortlist")

    def lowest(c: str) -> Column:
        return F.min(F.when(listed, F.col(c))).over(in_slice)

    def highest(c: str) -> Column:
        return F.max(F.when(listed, F.col(c))).over(in_slice)

    def normalised(c: str) -> Column:
        return lower_is_better(F.col(c), lowest(c), highest(c))

    score = rules.cost_weight * normalised("median_cost") + rules.latency_weight * normalised(
        "median_latency_ms"
    )
    best = F.max("avg_accuracy").over(in_slice)
    return summary.withColumn(
        "in_shortlist", F.col("avg_accuracy") >= best - rules.accuracy_tolerance
    ).withColumn("value_score", F.when(listed, score))


def shortlist(summary: DataFrame, slice_keys: list[str], rules: Policy = Policy()) -> DataFrame:
    return value_scores(summary, slice_keys, rules).where("in_shortlist").drop("in_shortlist")


def rank_slices(summary: DataFrame, slice_keys: list[str], rules: Policy = Policy()) -> DataFrame:
    """Add ``summary_rank`` (summary order) and ``value_rank`` (best value first)."""
    in_order = Window.partitionBy(*slice_keys).orderBy(*summary_order())
    by_value = Window.partitionBy(*slice_keys).orderBy(
        F.desc_nulls_last("value_score"), *summary_order()
    )
    return (
        value_scores(summary, slice_keys, rules)
        .withColumn("summary_rank", F.row_number().over(in_order).cast("bigint"))
        .withColumn("value_rank", F.row_number().over(by_value).cast("bigint"))
    )


def best_value(summary: DataFrame, slice_keys: list[str], rules: Policy = Policy()) -> DataFrame:
    return rank_slices(summary, slice_keys, rules).where(F.col("value_rank") == 1)


def top_candidates(ranked: DataFrame, slice_keys: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` models of each slice as an ordered array; the list never exceeds n."""
    return (
        ranked.where(F.col("summary_rank") <= n)
        .groupBy(*slice_keys)
        .agg(
            F.transform(
                F.sort_array(
                    F.collect_list(F.struct("summary_rank", rounded_stats().alias("stats")))
                ),
                lambda c: c["stats"],
            ).alias("top_candidates")
        )
    )


def slice_winners(ranked: DataFrame, slice_keys: list[str], rules: Policy = Policy()) -> DataFrame:
    """One row per slice: best value model, top candidates, and the size of the slice."""
    winners = ranked.groupBy(*slice_keys).agg(
        F.max(F.when(F.col("value_rank") == 1, rounded_stats())).alias("recommended"),
        F.max("slice_row_count").cast("bigint").alias("slice_row_count"),
        F.count(F.lit(1)).alias("models_considered"),
        F.countDistinct("model_id").alias("distinct_models_considered"),
    )
    return winners.join(top_candidates(ranked, slice_keys, rules.top_candidates), slice_keys)


def current_candidates(ranked: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Numbers of each model id of a slice; of several providers the best ranked counts."""
    return ranked.groupBy(*slice_keys, "model_id").agg(
        F.min_by(rounded_stats(), "summary_rank").alias("current")
    )


def deltas(recommended: str = "recommended", current: str = "current") -> dict[str, Column]:
    """Differences of the rounded numbers; null without a current model or at base zero."""
    new, old = F.col(recommended), F.col(current)

    def change(field: str) -> Column:
        return round_to(percent_change(new[field], old[field]), 1)

    return {
        "accuracy_delta": round_to(new["avg_accuracy"] - old["avg_accuracy"], 2),
        "accuracy_delta_pct": change("avg_accuracy"),
        "cost_delta_pct": change("median_cost"),
        "latency_delta_pct": change("median_latency_ms"),
    }


def switch_decision(found: Column, rules: Policy = Policy()) -> dict[str, Column]:
    """Whether to switch and why, from the delta columns; the first rule that holds decides."""
    gain = F.col("accuracy_delta")
    no_loss = gain.isNull() | (gain >= -rules.max_quality_loss)
    cheaper = F.col("cost_delta_pct") <= -rules.min_cost_improvement_pct
    faster = F.col("latency_delta_pct") <= -rules.min_latency_improvement_pct
    reason = (
        F.when(~found, policy.REASON_NO_CURRENT)
        .when(gain >= rules.min_accuracy_gain, policy.REASON_ACCURACY)
        .when(cheaper & no_loss, policy.REASON_COST)
        .when(faster & no_loss, policy.REASON_LATENCY)
        .otherwise(policy.REASON_STAY)
    )
    return {"policy_reason": reason, "switch_recommended": reason != policy.REASON_STAY}


def reason_text(filter_level: Column, current_model: Column, found: Column) -> Column:
    """The sentence shown to the user; expects ``recommended`` and the decision columns."""
    model = F.col("recommended")["model_id"]
    name = F.concat(F.col("recommended")["provider"], F.lit("/"), model)
    why = F.col("policy_reason")
    return (
        F.when(
            ~found,
            F.concat(
                name,
                F.lit(" is the best value option in the "),
                filter_level,
                F.lit(" benchmark slice. "),
                why,
            ),
        )
        .when(
            F.col("switch_recommended"),
            F.concat(
                F.lit("Switch from "), current_model, F.lit(" to "), model, F.lit(". "), why
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Stay on "),
                current_model,
                F.lit(". "),
                why,
                F.lit(" The best alternative in the "),
                filter_level,
                F.lit(" slice was "),
                name,
                F.lit("."),
            )
        )
    )


def warnings(current_model: Column, found: Column) -> Column:
    text = F.concat(
        F.lit("Current model '"),
        current_model,
        F.lit(
            "' was not found in the matched benchmark slice, so comparison deltas were skipped."
        ),
    )
    return F.when(found, F.array().cast("array<string>")).otherwise(F.array(text))


def _composite(
    stats: DataFrame, slice_keys: list[str], weights: Weights, normalise, metrics: tuple[str, ...]
) -> DataFrame:
    in_slice = Window.partitionBy(*slice_keys)

    def scaled(c: str, higher_is_better: bool) -> Column:
        low, high = F.min(c).over(in_slice), F.max(c).over(in_slice)
        return normalise(F.col(c), low, high, higher_is_better)

    accuracy, cost, latency = metrics
    score = (
        weights.accuracy * scaled(accuracy, True)
        + weights.cost * scaled(cost, False)
        + weights.latency * scaled(latency, False)
    )
    scored = stats.withColumn("composite_score", score)
    ranking = Window.partitionBy(*slice_keys).orderBy(
        F.desc("composite_score"), F.asc("model_id"), F.asc("provider")
    )
    return scored.withColumn("rank", F.row_number().over(ranking).cast("bigint"))


def _floored_range(value: Column, low: Column, high: Column, higher: bool) -> Column:
    share = (value - low) / F.greatest(high - low, F.lit(1e-9))
    return share if higher else 1 - share


def _one_when_flat(value: Column, low: Column, high: Column, higher: bool) -> Column:
    share = F.try_divide(value - low, high - low)
    return F.when(high == low, F.lit(1.0)).otherwise(share if higher else 1 - share)


def composite_ranking(
    rounded: DataFrame,
    weights: Weights = Weights(),
    min_samples: int = policy.PROFILE_MIN_SAMPLES,
) -> DataFrame:
    """Rank the profiles of each complexity by a weighted score of their rounded numbers.

    Equal numbers give accuracy share 0 and cost and latency share 1.
    """
    return _composite(
        rounded.where(F.col("sample_count") >= min_samples),
        ["prompt_complexity"],
        weights,
        _floored_range,
        ("avg_accuracy", "avg_cost", "avg_latency_ms"),
    )


def mean_composite_ranking(
    means: DataFrame, weights: Weights = policy.MEAN_ONLY_WEIGHTS
) -> DataFrame:
    """Rank the mean summary of each (use case, complexity); equal numbers all count as 1."""
    return _composite(
        means,
        ["use_case", "prompt_complexity"],
        weights,
        _one_when_flat,
        ("avg_accuracy", "avg_cost", "avg_latency"),
    )


def top_recommendations(ranked: DataFrame, n: int = policy.PROFILE_TOP_N) -> DataFrame:
    return ranked.where(F.col("rank") <= n).withColumn(
        "composite_score", round_to(F.col("composite_score"), 4)
    )


def profile_deltas(
    requests: DataFrame, ranked: DataFrame, rounded: DataFrame
) -> DataFrame:
    """Compare the best profile of a complexity with the current model of each request.

    ``requests`` has ``complexity`` and ``current_model``. Without a usable
    current model the worst ranked profile is compared, if there is another one.
    ``ranked`` and ``rounded`` have one row per model and complexity.
    """
    numbers = F.struct("model_id", "avg_accuracy", "avg_cost", "avg_latency_ms")
    ends = ranked.groupBy(F.col("prompt_complexity").alias("complexity")).agg(
        F.min_by(numbers, "rank").alias("_best"),
        F.max_by(numbers, "rank").alias("_worst"),
        F.count(F.lit(1)).alias("all_models_count"),
    )
    current = rounded.groupBy(
        F.col("prompt_complexity").alias("complexity"), F.col("model_id").alias("current_model")
    ).agg(F.max_by(numbers, "provider").alias("_current"))
    with_ends = requests.join(settle(ends), ["complexity"], "left")
    joined = with_ends.join(
        settle(current), ["complexity", "current_model"], "left"
    )
    worst = F.when(F.col("all_models_count") > 1, F.col("_worst"))
    old = F.coalesce("_current", worst)
    joined = joined.withColumn("_from", old)
    best, base = F.col("_best"), F.col("_from")

    def percent(c: str) -> Column:
        return round_to(floored_percent_change(best[c], base[c], 1e-9), 1)

    return joined.select(
        *requests.columns,
        F.col("_from")["model_id"].alias("from_model"),
        F.when(base.isNotNull(), best["model_id"]).alias("to_model"),
        round_to(best["avg_accuracy"] - base["avg_accuracy"], 2).alias("accuracy_delta"),
        round_to(best["avg_cost"] - base["avg_cost"], 6).alias("cost_delta"),
        percent("avg_cost").alias("cost_delta_pct"),
        round_to(best["avg_latency_ms"] - base["avg_latency_ms"], 1).alias("latency_delta_ms"),
        percent("avg_latency_ms").alias("latency_delta_pct"),
        F.coalesce("all_models_count", F.lit(0)).alias("all_models_count"),
    )


def mean_deltas(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Compare the best mean summary with the current model; an absent one counts as zeros.

    ``requests`` has ``use_case``, ``complexity`` and ``current_model``.
    """
    keys = ["use_case", "complexity"]
    numbers = F.struct("model_id", "avg_accuracy", "avg_cost", "avg_latency")
    named = ranked.withColumnRenamed("prompt_complexity", "complexity")
    best = named.where(F.col("rank") == 1).select(*keys, numbers.alias("_best"))
    current = named.select(
        *keys, F.col("model_id").alias("current_model"), numbers.alias("_current")
    )
    joined = requests.join(settle(best), keys).join(
        settle(current), [*keys, "current_model"], "left"
    )
    new = F.col("_best")

    def old(c: str) -> Column:
        return F.coalesce(F.col("_current")[c], F.lit(0.0))

    reason = F.concat(
        F.initcap("complexity"),
        F.lit("-complexity "),
        F.col("use_case"),
        F.lit(" prompt. "),
        new["model_id"],
        F.lit(" outperforms "),
        F.col("current_model"),
        F.lit(" on this task type in our benchmark data."),
    )
    return joined.select(
        *requests.columns,
        new["model_id"].alias("recommended_model"),
        round_to(new["avg_accuracy"] - old("avg_accuracy"), 1).alias("accuracy_delta"),
        round_to(
            floored_percent_change(new["avg_cost"], old("avg_cost"), 0.0001), 1
        ).alias("cost_delta"),
        (new["avg_latency"] - old("avg_latency")).cast("bigint").alias("latency_delta"),
        reason.alias("reason"),
    )


