"""Cleaning, checking and filtering rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.columns import compute_once
from benchsieve.functions.numbers import parse_number
from benchsieve.functions.text import is_blank, normalise_prompt, strip

KEYS = ("model_id", "provider", "use_case", "prompt_complexity", "clarity")
METRICS = ("accuracy_score", "cost", "latency_ms")


def _normalised(rows: DataFrame) -> DataFrame:
    if "tokens" in rows.columns:
        rows = rows.withColumn("tokens", parse_number(rows, "tokens"))
    return compute_once(
        rows,
        {
            "model_id": strip(F.col("model_id")),
            "provider": F.coalesce(strip(F.col("provider")), F.lit("")),
            "use_case": F.lower(strip(F.col("use_case"))),
            "prompt_complexity": F.lower(strip(F.col("prompt_complexity"))),
            "clarity": F.upper(strip(F.col("clarity"))),
            **{m: parse_number(rows, m) for m in METRICS},
        },
    )


def _all_present(names: tuple[str, ...]) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    return present


def clean_benchmark(rows: DataFrame) -> DataFrame:
    """Rows with a model, a use case, three numeric metrics and labels of the domain."""
    return _normalised(rows).where(
        _all_present(METRICS)
        & (F.col("model_id") != "")
        & (F.col("use_case") != "")
        & F.col("prompt_complexity").isin(*policy.COMPLEXITIES)
        & F.col("clarity").isin(*policy.CLARITIES)
    )


def clean_benchmark_loose(rows: DataFrame) -> DataFrame:
    """Rows with all keys and numeric metrics; labels are not checked against the domain."""
    return _normalised(rows).where(
        _all_present(("model_id", "use_case", "prompt_complexity", "clarity", *METRICS))
    )


def clean_for_profiles(rows: DataFrame) -> DataFrame:
    """Rows with model, complexity and accuracy; cost, latency and tokens may be null."""
    numbers = {m: parse_number(rows, m) for m in ("cost", "latency_ms", "tokens")}
    checked = compute_once(
        rows.where(F.col("model_id").isNotNull() & F.col("prompt_complexity").isNotNull()),
        {"accuracy_score": parse_number(rows, "accuracy_score")},
    ).where(F.col("accuracy_score").isNotNull())
    return checked.withColumns(
        {"prompt_complexity": F.lower(strip(F.col("prompt_complexity"))), **numbers}
    )


def clean_prompt_logs(logs: DataFrame) -> DataFrame:
    return logs.dropna(subset=["prompt", "use_case", "clarity"]).withColumns(
        {
            "normalized_prompt": normalise_prompt(F.col("prompt")),
            "use_case": F.lower(strip(F.col("use_case"))),
            "clarity": F.upper(strip(F.col("clarity"))),
        }
    )


def distinct_labelled_prompts(rows: DataFrame) -> DataFrame:
    """Distinct (prompt, complexity) pairs with a non-blank prompt and a known label."""
    return (
        rows.select(
            strip(F.col("prompt")).alias("prompt"),
            F.lower(strip(F.col("prompt_complexity"))).alias("prompt_complexity"),
        )
        .where((F.col("prompt") != "") & F.col("prompt_complexity").isin(*policy.COMPLEXITIES))
        .dropDuplicates()
    )


def quality_violations(rows: DataFrame) -> DataFrame:
    """Rows checked and rows breaking each rule of the benchmark table, in one pass."""
    score, complexity = F.col("accuracy_score"), F.col("prompt_complexity")
    checked = compute_once(
        rows,
        {
            "accuracy_score": parse_number(rows, "accuracy_score"),
            "prompt_complexity": F.lower(strip(F.col("prompt_complexity"))),
        },
    )
    return checked.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(
            complexity.isNull() | ~complexity.isin(*policy.COMPLEXITIES)
        ).alias("bad_complexity"),
        F.count_if(score.isNull()).alias("bad_score_format"),
        F.count_if((score < 0) | (score > 100)).alias("score_out_of_range"),
    )


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful responses, and failures with zero score, cost and tokens."""
    failed = is_blank(F.col("response"))
    failures = responses.where(failed).withColumns(
        {
            "accuracy_score": F.lit(0).cast("bigint"),
            "cost": F.lit(0.0),
            "tokens": F.lit(0).cast("bigint"),
            "reason": F.lit("Model returned null/empty response"),
        }
    )
    return responses.where(~failed), failures


def restrict_models(rows: DataFrame, allowed: DataFrame, model: str = "model_id") -> DataFrame:
    """Rows whose model is run for their use case.

    ``allowed`` is the fixed table of use cases and models, so it is broadcast.
    """
    keep = F.broadcast(allowed.select("use_case", F.col("short_id").alias(model)))
    return rows.join(keep, ["use_case", model], "left_semi")


def require_known_use_case(rows: DataFrame) -> DataFrame:
    """Add ``error`` for a use case without a model list."""
    unknown = F.col("use_case").isNull() | ~F.col("use_case").isin(*policy.USE_CASES)
    names = ", ".join(policy.USE_CASES)
    return rows.withColumn(
        "error",
        F.when(
            unknown,
            F.concat(
                F.lit("Unknown use_case '"),
                F.coalesce("use_case", F.lit("None")),
                F.lit(f"'. Must be one of: {names}"),
            ),
        ),
    )


def default_use_case(use_case: Column) -> Column:
    """The use case in lower case; null and unknown names become the default."""
    name = F.lower(strip(use_case))
    return F.when(name.isin(*policy.USE_CASES), name).otherwise(policy.DEFAULT_USE_CASE)


def filter_events(events: DataFrame, complexity: str = "all") -> DataFrame:
    if complexity == "all":
        return events
    return events.where(F.col("prompt_complexity") == complexity)


def filter_catalog(options: DataFrame, use_case: str) -> DataFrame:
    """Catalog rows that list the use case."""
    return options.where(F.array_contains("use_cases", use_case))


def clean_relabel_input(rows: DataFrame) -> DataFrame:
    """Prompts to relabel; ``row_pos`` is the source position and becomes the id."""
    return rows.select(
        F.col("row_pos").cast("string").alias("prompt_id"),
        strip(F.coalesce("prompt", F.lit(""))).alias("prompt"),
        F.lower(strip(F.coalesce("use_case", F.lit("")))).alias("use_case"),
        F.upper(strip(F.coalesce("clarity", F.lit("")))).alias("clarity"),
        F.lower(strip(F.coalesce("prompt_complexity", F.lit("")))).alias("old_prompt_complexity"),
    ).where(
        (F.col("prompt") != "")
        & F.col("use_case").isin(*policy.USE_CASES)
        & F.col("clarity").isin(*policy.CLARITIES)
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Normalise use case and overrides; ``error`` names the first bad field.

    An empty override counts as absent.
    """
    use_case = F.lower(strip(F.col("use_case")))

    def optional(name: str, change) -> Column:
        if name not in requests.columns:
            return F.lit(None).cast("string")
        return F.nullif(change(strip(F.col(name))), F.lit(""))

    complexity = optional("complexity_override", F.lower)
    clarity = optional("clarity_override", F.upper)

    def unsupported(field: str, value: Column) -> Column:
        return F.concat(
            F.lit(f"Unsupported {field} '"), F.coalesce(value, F.lit("")), F.lit("'.")
        )

    return requests.withColumns(
        {
            "use_case": use_case,
            "complexity_override": complexity,
            "clarity_override": clarity,
            "error": F.when(
                F.coalesce(~use_case.isin(*policy.USE_CASES), F.lit(True)),
                unsupported("use_case", use_case),
            )
            .when(~complexity.isin(*policy.COMPLEXITIES), unsupported("complexity", complexity))
            .when(~clarity.isin(*policy.CLARITIES), unsupported("clarity", clarity)),
        }
    )
