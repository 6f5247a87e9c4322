"""Prompt signals: complexity and clarity, from overrides, logs, classifier or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.durable import settle
from benchsieve.functions.numbers import round_to
from benchsieve.functions.text import contains_any, normalise_prompt, strip, word_count


def _with_text_features(df: DataFrame) -> DataFrame:
    """Lower case text and word counts as columns, so that each is computed once.

    Lower case has other words only where a dotted capital I occurs.
    """
    return (
        df.withColumn("_lowered", F.lower("prompt"))
        .withColumn("_lowered_words", word_count(F.col("_lowered")))
        .withColumn(
            "_words",
            F.when(
                F.contains(F.col("prompt"), F.lit("\u0130")), word_count(F.col("prompt"))
            ).otherwise(F.col("_lowered_words")),
        )
    )


def _complexity() -> Column:
    lowered, words = F.col("_lowered"), F.col("_lowered_words")
    return (
        F.when(
            (words <= policy.LOW_MAX_WORDS) & ~contains_any(lowered, policy.NOT_LOW_TOKENS), "low"
        )
        .when(
            (words >= policy.HIGH_MIN_WORDS) | contains_any(lowered, policy.HIGH_TOKENS), "high"
        )
        .otherwise("mid")
    )


def _clarity() -> Column:
    lowered, words = F.col("_lowered"), F.col("_words")
    return (
        F.when((words <= 3) | contains_any(lowered, policy.AMBIGUOUS_MARKERS), "UNCLEAR")
        .when(
            F.col("_has_task")
            & ((words >= 8) | contains_any(lowered, policy.CONSTRAINT_MARKERS)),
            "CLEAR",
        )
        .when(F.col("_has_task") | (words >= 6), "PARTIAL")
        .otherwise("UNCLEAR")
    )


def with_heuristics(df: DataFrame) -> DataFrame:
    """Add ``heuristic_complexity`` and ``heuristic_clarity`` of the ``prompt`` column."""
    return (
        _with_text_features(df)
        .withColumn("_has_task", contains_any(F.col("_lowered"), policy.TASK_VERBS))
        .withColumns({"heuristic_complexity": _complexity(), "heuristic_clarity": _clarity()})
        .drop("_lowered", "_lowered_words", "_words", "_has_task")
    )


def _vote(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label per key; equal counts go to the label first in the alphabet.

    One grouping with three conditional counts: partial counts are combined
    before the shuffle, however many rows one prompt has.
    """
    votes = {label: F.count_if(F.col("_label") == label) for label in policy.CLARITIES}
    counted = (
        logs.withColumn("_label", F.upper(strip(F.col("clarity"))))
        .where(F.col("_label").isin(*policy.CLARITIES))
        .groupBy(*keys)
        .agg(*[n.alias(label) for label, n in votes.items()])
    )
    top = F.greatest(*policy.CLARITIES)
    label = F.lit(None).cast("string")
    for name in sorted(policy.CLARITIES, reverse=True):
        label = F.when(F.col(name) == top, name).otherwise(label)
    return counted.select(*keys, label.alias("clarity"))


def clarity_votes_exact(logs: DataFrame) -> DataFrame:
    """(use_case, prompt) to clarity, for logs whose prompt is compared as it is."""
    return _vote(logs.where(F.col("prompt").isNotNull()), ["use_case", "prompt"])


def clarity_votes_normalised(logs: DataFrame) -> DataFrame:
    """(use_case, normalised prompt) to clarity."""
    keyed = logs.where(F.col("prompt").isNotNull()).select(
        F.lower(strip(F.col("use_case"))).alias("use_case"),
        normalise_prompt(F.col("prompt")).alias("normalized_prompt"),
        "clarity",
    )
    return _vote(keyed, ["use_case", "normalized_prompt"])


def _digest(text: Column) -> Column:
    """SHA-256 of a text: it stands for the text in keys, so that no text is grouped, sorted or moved."""
    return F.sha2(text, 256)


def _look_up(requests: DataFrame, votes: DataFrame, digest: str, name: str) -> DataFrame:
    """Left join on the digest of the text.

    The votes are settled, so the planner knows their size: few votes are
    broadcast and the requests stay in place.
    """
    keyed = settle(votes.withColumnRenamed("clarity", name))
    return requests.join(keyed, ["use_case", digest], "left")


def clarity_from_logs(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Add ``_clarity_exact`` and ``_clarity_normalised`` to the requests.

    The votes are those of ``clarity_votes_exact`` and ``clarity_votes_normalised`` by the
    digests of their texts. The texts of the logs are read once for both.
    """
    digests = {"_exact": _digest(F.col("prompt")), "_normalised": _digest(normalise_prompt(F.col("prompt")))}
    read = logs.where(F.col("prompt").isNotNull()).withColumns(digests)
    read = settle(read.select("use_case", "clarity", *digests))
    exact = _vote(read, ["use_case", "_exact"])
    cleaned = read.withColumn("use_case", F.lower(strip(F.col("use_case"))))
    normalised = _vote(cleaned, ["use_case", "_normalised"])
    asked = requests.withColumns(digests)
    asked = _look_up(asked, exact, "_exact", "_clarity_exact")
    return _look_up(asked, normalised, "_normalised", "_clarity_normalised").drop(*digests)


def resolve_signals(requests: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Add complexity and clarity, and the source of each.

    Optional request columns: ``complexity_override``, ``clarity_override``, and
    ``predicted_complexity`` with ``predicted_confidence`` from a classifier.
    """
    requests = with_heuristics(requests)
    if logs is not None:
        requests = clarity_from_logs(requests, logs)

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in requests.columns else F.lit(None).cast(kind)

    override_complexity = optional("complexity_override")
    predicted = F.lower(strip(optional("predicted_complexity")))
    predicted = F.when(predicted.isin(*policy.COMPLEXITIES), predicted)
    override_clarity = optional("clarity_override")
    exact = optional("_clarity_exact")
    normalised = optional("_clarity_normalised")

    complexity_source = (
        F.when(override_complexity.isNotNull(), "manual_override")
        .when(predicted.isNotNull(), "classifier")
        .otherwise("heuristic")
    )
    clarity_source = (
        F.when(override_clarity.isNotNull(), "manual_override")
        .when(exact.isNotNull(), "prompt_logs_exact")
        .when(normalised.isNotNull(), "prompt_logs_local_exact")
        .otherwise("heuristic")
    )
    return requests.withColumns(
        {
            "complexity": F.coalesce(override_complexity, predicted, F.col("heuristic_complexity")),
            "complexity_confidence": F.when(
                override_complexity.isNull() & predicted.isNotNull(),
                round_to(optional("predicted_confidence", "double"), 3),
            ),
            "complexity_source": complexity_source,
            "clarity": F.coalesce(override_clarity, exact, normalised, F.col("heuristic_clarity")),
            "clarity_source": clarity_source,
        }
    ).drop(
        "_clarity_exact",
        "_clarity_normalised",
        "predicted_complexity",
        "predicted_confidence",
        "heuristic_complexity",
        "heuristic_clarity",
    )
