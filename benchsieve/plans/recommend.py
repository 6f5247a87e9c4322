"""Recommend a model for every request of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.durable import settle
from benchsieve.operators import rank
from benchsieve.operators.aggregate import TIER_SLICE, supported_slices
from benchsieve.operators.clean import validate_requests
from benchsieve.operators.signals import resolve_signals
from benchsieve.policy import Policy

ROUTE = ["use_case", "complexity", "clarity"]


def slice_routes(ranked: DataFrame) -> DataFrame:
    """For each use case, complexity and clarity, the narrowest slice with a supported model.

    There are at most 9 rows per use case.
    """
    slices = ranked.select(*TIER_SLICE).distinct()

    def members(column: str, domain: tuple[str, ...]):
        every = F.array(*[F.lit(v) for v in domain])
        return F.explode(
            F.when(F.col(column) == policy.ANY, every).otherwise(F.array(column))
        )

    reachable = slices.withColumn(
        "complexity", members("slice_complexity", policy.COMPLEXITIES)
    ).withColumn("clarity", members("slice_clarity", policy.CLARITIES))
    narrowest = Window.partitionBy(*ROUTE).orderBy("tier")
    return (
        reachable.withColumn("_choice", F.row_number().over(narrowest))
        .where(F.col("_choice") == 1)
        .drop("_choice")
    )


def tier_name(tier: str = "tier"):
    names = F.array(*[F.lit(t) for t in policy.TIERS])
    return F.coalesce(F.get(names, F.col(tier)), F.lit("none"))


def slice_tables(
    bench: DataFrame, rules: Policy = Policy()
) -> tuple[DataFrame, DataFrame]:
    """Winner per route, and numbers per route and model id, ready to be joined.

    All ranking is done once per slice and settled, so the planner knows the size of
    both tables and chooses how to join them.
    """
    ranked = settle(rank.rank_slices(supported_slices(bench, rules.min_samples), TIER_SLICE, rules))
    routes = slice_routes(ranked)
    winners = routes.join(rank.slice_winners(ranked, TIER_SLICE, rules), TIER_SLICE)
    current = routes.join(rank.current_candidates(ranked, TIER_SLICE), TIER_SLICE)
    current = current.select(*ROUTE, F.col("model_id").alias("current_model"), "current")
    return settle(winners.drop("slice_complexity", "slice_clarity")), settle(current)


def recommend(
    requests: DataFrame,
    bench: DataFrame,
    logs: DataFrame | None = None,
    rules: Policy = Policy(),
    tell_no_data: bool = False,
) -> DataFrame:
    """The recommendation for every request, in one job.

    ``requests`` has ``prompt``, ``use_case``, ``current_model`` and any key
    columns. ``bench`` holds clean rows, ``logs`` prompt logs. Instead of an
    exception a request that cannot be answered has ``error``. A ``data_source``
    column of ``bench``, one value per use case, is passed on. ``tell_no_data`` tells use
    cases without any benchmark row from those without a supported slice.
    """
    bench = bench.where(F.col("use_case").isin(*policy.USE_CASES))
    winners, current = slice_tables(bench, rules)
    present = list(policy.USE_CASES)
    if tell_no_data:  # at most one row per known use case
        present = [r["use_case"] for r in bench.select("use_case").distinct().collect()]
    asked = resolve_signals(validate_requests(requests), logs)
    if "data_source" in bench.columns:
        # One row per known use case.
        origin = bench.groupBy("use_case").agg(F.min("data_source").alias("data_source"))
        asked = asked.join(F.broadcast(origin), ["use_case"], "left")
    else:
        asked = asked.withColumn("data_source", F.lit("primary"))
    matched = asked.join(winners, ROUTE, "left").join(current, [*ROUTE, "current_model"], "left")
    answered = F.col("recommended").isNotNull() & F.col("error").isNull()
    found = F.col("current").isNotNull()
    matched = matched.withColumns(
        {
            "recommended": F.when(answered, F.col("recommended")),
            "filter_level": F.when(answered, tier_name()).otherwise("none"),
            "error": F.coalesce(
                "error",
                F.when(~F.col("use_case").isin(*present), policy.ERROR_NO_DATA) if tell_no_data else F.lit(None),
                F.when(~answered, policy.ERROR_NO_SLICE),
            ),
        }
    )
    decided = matched.withColumns(rank.deltas()).withColumns(rank.switch_decision(found, rules))
    consumed = {
        "use_case",
        "complexity_override",
        "clarity_override",
        "predicted_complexity",
        "predicted_confidence",
    }
    keys = [c for c in requests.columns if c not in consumed]
    best = F.col("recommended")

    def only_answered(column):
        return F.when(F.col("error").isNull(), column)

    return decided.select(
        *keys,
        "use_case",
        "complexity",
        "complexity_confidence",
        "complexity_source",
        F.lit(None).cast("int").alias("quality_score"),
        "clarity",
        "clarity_source",
        "filter_level",
        F.lit("best_value").alias("recommendation_mode"),
        "data_source",
        only_answered(found).alias("current_model_found"),
        only_answered(F.col("current")).alias("current_model_stats"),
        best["model_id"].alias("recommended_model"),
        best["provider"].alias("recommended_provider"),
        best["avg_accuracy"].alias("expected_accuracy"),
        best["median_cost"].alias("expected_cost"),
        best["median_latency_ms"].alias("expected_latency"),
        "accuracy_delta",
        "accuracy_delta_pct",
        "cost_delta_pct",
        "latency_delta_pct",
        best["sample_count"].alias("sample_size"),
        only_answered(F.col("slice_row_count")).alias("slice_row_count"),
        only_answered(F.col("models_considered")).alias("models_considered"),
        only_answered(F.col("distinct_models_considered")).alias("distinct_models_considered"),
        only_answered(F.col("switch_recommended")).alias("switch_recommended"),
        only_answered(
            F.when(F.col("switch_recommended"), best["model_id"]).otherwise(F.col("current_model"))
        ).alias("final_suggestion_model"),
        only_answered(F.col("policy_reason")).alias("policy_reason"),
        only_answered(
            rank.reason_text(F.col("filter_level"), F.col("current_model"), found)
        ).alias("reason"),
        only_answered(F.col("top_candidates")).alias("top_candidates"),
        only_answered(rank.warnings(F.col("current_model"), found)).alias("warnings"),
        "error",
    )
