"""Raw provider responses: text, tokens, cost, and benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.numbers import round_to
from benchsieve.operators.clean import split_responses

# The fields read from the bodies of all response formats.
BODY = """
  text string,
  generation string, prompt_token_count double, generation_token_count double,
  output struct<message:struct<content:array<struct<text:string>>>>,
  content array<struct<text:string>>,
  choices array<struct<message:struct<content:string,reasoning_content:string>>>,
  outputs array<struct<text:string>>,
  usage struct<inputTokens:double,outputTokens:double,input_tokens:double,output_tokens:double,
    prompt_tokens:double,completion_tokens:double>,
  usage_metadata struct<prompt_token_count:double,candidates_token_count:double>
"""


def _first(array: str) -> Column:
    return F.get(F.col(f"_body.{array}"), F.lit(0))


def _first_positive(*counts: Column) -> Column:
    """The first count other than 0; counts may be written as 3 or 3.0."""
    whole = [c.cast("bigint") for c in counts]
    return F.coalesce(*[F.when(c != 0, c) for c in whole], F.lit(0).cast("bigint"))


def _text() -> Column:
    fmt = F.col("fmt")
    other = F.coalesce(
        F.nullif(_first("content")["text"], F.lit("")),
        F.nullif(_first("choices")["message"]["content"], F.lit("")),
        _first("outputs")["text"],
    )
    text = (
        F.when(fmt == "meta", F.col("_body.generation"))
        .when(fmt == "nova", F.get(F.col("_body.output.message.content"), F.lit(0))["text"])
        .when(fmt == "gemini", F.col("_body.text"))
        .otherwise(other)
    )
    return F.coalesce(text, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, at least 1; 0 for empty text."""
    quarter = F.floor(F.char_length(text) / 4)
    return F.when(
        F.char_length(text) > 0, F.greatest(quarter, F.lit(1).cast("bigint"))
    ).otherwise(F.lit(0).cast("bigint"))


def _tokens() -> tuple[Column, Column]:
    fmt = F.col("fmt")
    usage = F.col("_body.usage")
    reported_in = _first_positive(usage["input_tokens"], usage["prompt_tokens"])
    reported_out = _first_positive(usage["output_tokens"], usage["completion_tokens"])
    # An object without the known counters still counts as usage, unless it is empty.
    has_usage = usage.isNotNull() & (
        (reported_in + reported_out > 0)
        | (F.coalesce(F.get_json_object("raw_body", "$.usage"), F.lit("{}")) != "{}")
    )
    message = _first("choices")["message"]
    output = F.concat(
        F.coalesce(message["content"], F.lit("")),
        F.coalesce(message["reasoning_content"], F.lit("")),
    )

    def pick(meta: Column, nova: Column, gemini: Column, reported: Column, guess: Column) -> Column:
        count = (
            F.when(fmt == "meta", meta)
            .when(fmt == "nova", nova)
            .when(fmt == "gemini", gemini)
            .when(has_usage, reported)
            .otherwise(guess)
        )
        return F.coalesce(count, F.lit(0)).cast("bigint")

    metadata = F.col("_body.usage_metadata")
    return (
        pick(
            F.col("_body.prompt_token_count"),
            usage["inputTokens"],
            metadata["prompt_token_count"],
            reported_in,
            estimate_tokens(F.coalesce("prompt", F.lit(""))),
        ),
        pick(
            F.col("_body.generation_token_count"),
            usage["outputTokens"],
            metadata["candidates_token_count"],
            reported_out,
            estimate_tokens(output),
        ),
    )


def parse_responses(raw: DataFrame) -> DataFrame:
    """Add ``response``, ``input_tokens``, ``output_tokens`` and ``tokens``.

    ``raw`` has ``fmt``, ``prompt`` and the JSON text ``raw_body``, which is parsed
    once. A body that is not JSON has an empty response.
    """
    tokens_in, tokens_out = _tokens()
    return (
        raw.withColumn("_body", F.from_json("raw_body", BODY))
        .withColumns({"response": _text(), "input_tokens": tokens_in, "output_tokens": tokens_out})
        .withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
        .drop("_body")
    )


def with_cost(responses: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` in USD; a model without a price takes the default of its format.

    ``prices`` is the fixed price table, so it is broadcast.
    """
    default_in, default_out = policy.DEFAULT_PRICE
    gemini_in, gemini_out = policy.DEFAULT_GEMINI_PRICE
    is_gemini = F.col("fmt") == "gemini"
    price_in = F.coalesce("price_in", F.when(is_gemini, gemini_in).otherwise(default_in))
    price_out = F.coalesce("price_out", F.when(is_gemini, gemini_out).otherwise(default_out))
    cost = F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out
    return (
        responses.join(F.broadcast(prices), "short_id", "left")
        .withColumn("cost", round_to(cost, 6))
        .drop("price_in", "price_out")
    )


def benchmark_rows(responses: DataFrame, scores: DataFrame, prompts: DataFrame) -> DataFrame:
    """Benchmark rows of the successful responses; a response without a score has 0.

    ``scores`` has one row per ``prompt_id`` and ``model_id``; ``prompts`` has
    ``prompt_id``, ``prompt_complexity``, ``use_case`` and ``clarity``.
    """
    successful, _ = split_responses(responses)
    given = scores.select("prompt_id", "model_id", "accuracy_score")
    scored = successful.join(given, ["prompt_id", "model_id"], "left")
    attributes = prompts.select("prompt_id", "prompt_complexity", "use_case", "clarity")
    return scored.join(attributes, ["prompt_id"]).select(
        "prompt_id",
        "provider",
        "model_id",
        "prompt",
        "prompt_complexity",
        "use_case",
        "clarity",
        "response",
        F.coalesce("accuracy_score", F.lit(0.0)).alias("accuracy_score"),
        "cost",
        "tokens",
        "latency_ms",
    )
