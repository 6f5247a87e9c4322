"""Named queries over the given tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from benchsieve import policy
from benchsieve.functions.durable import discard, new_folder, settle, shared_folder
from benchsieve.functions.numbering import number_rows
from benchsieve.functions.numbers import round_to
from benchsieve.functions.text import normalise_prompt
from benchsieve.operators import aggregate, classify, clean, labels, rank, responses, signals
from benchsieve.operators.answers import AnswerLog
from benchsieve.operators.aggregate import TIER_SLICE
from benchsieve.plans import profiles as profile_plans
from benchsieve.plans.recommend import recommend
from benchsieve.policy import Policy
from benchsieve.sources import readers, writers
from benchsieve.sources.adapters import table, view, view_sql, with_raw_body
from benchsieve.sources.readers import combine_phases
from benchsieve.streaming import ending, jobs, rollups
from benchsieve.streaming.store import UpdateStore

# The number of terms of the classifier that is matched; five fits over all terms take too long.
FOLD_FEATURES = 5000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def bench(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_benchmark(view(spark, sf, "bench_raw"))


def profile_rows(spark: SparkSession, sf: str) -> DataFrame:
    phases = [view(spark, sf, "bench_raw"), view(spark, sf, "bench_phase")]
    return clean.clean_for_profiles(combine_phases(phases))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "prompts")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "prompt_logs")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with resolved complexity and clarity."""
    return signals.resolve_signals(prompts(spark, sf), logs(spark, sf))


def ranked(spark: SparkSession, sf: str, min_samples: int = 5) -> DataFrame:
    summary = aggregate.supported_slices(bench(spark, sf), min_samples)
    return rank.rank_slices(summary, TIER_SLICE)


def flat_profiles(spark: SparkSession, sf: str) -> DataFrame:
    nested = aggregate.nested_profiles(profile_rows(spark, sf))
    return profile_plans.flatten_profiles(nested)


BENCH = ["src_id", *clean.KEYS, *clean.METRICS, "tokens"]
SUMMARY = list(aggregate.SUMMARY)


@query
def clean_bench(spark, sf):
    return bench(spark, sf).select(*BENCH)


@query
def clean_bench_loose(spark, sf):
    return clean.clean_benchmark_loose(view(spark, sf, "bench_raw")).select(*BENCH)


@query
def dq_violations(spark, sf):
    return clean.quality_violations(view(spark, sf, "bench_raw"))


@query
def prompt_norm(spark, sf):
    return prompts(spark, sf).select(
        "prompt_id", normalise_prompt(F.col("prompt")).alias("normalized_prompt")
    )


@query
def clean_logs(spark, sf):
    return clean.clean_prompt_logs(logs(spark, sf)).select(
        "normalized_prompt", "use_case", "clarity"
    )


@query
def complexity_heuristic(spark, sf):
    return signals.with_heuristics(prompts(spark, sf)).select(
        "prompt_id", F.col("heuristic_complexity").alias("complexity")
    )


@query
def clarity_heuristic(spark, sf):
    return signals.with_heuristics(prompts(spark, sf)).select(
        "prompt_id", F.col("heuristic_clarity").alias("clarity")
    )


@query
def clarity_vote_exact(spark, sf):
    return signals.clarity_votes_exact(logs(spark, sf))


@query
def clarity_vote_norm(spark, sf):
    return signals.clarity_votes_normalised(logs(spark, sf))


@query
def signals_resolved(spark, sf):
    return requests(spark, sf).select(
        "prompt_id", "use_case", "complexity", "clarity", "clarity_source"
    )


@query
def model_summary(spark, sf):
    return aggregate.model_summary(bench(spark, sf), 5)


def _slice_summary(min_samples: int) -> Query:
    def run(spark, sf):
        return aggregate.supported_slices(bench(spark, sf), min_samples)

    return run


def _recommend(min_samples: int) -> Query:
    def run(spark, sf):
        answers = recommend(
            prompts(spark, sf), bench(spark, sf), logs(spark, sf), Policy(min_samples=min_samples)
        )
        return flat_recommendation(answers)

    return run


def flat_recommendation(answers: DataFrame) -> DataFrame:
    """Scalar columns of a recommendation, with lists as text."""
    return answers.select(
        "prompt_id",
        "use_case",
        "complexity",
        "clarity",
        "clarity_source",
        "filter_level",
        "current_model",
        "current_model_found",
        "recommended_model",
        "recommended_provider",
        "expected_accuracy",
        "expected_cost",
        "expected_latency",
        "accuracy_delta",
        "accuracy_delta_pct",
        "cost_delta_pct",
        "latency_delta_pct",
        "sample_size",
        "slice_row_count",
        "models_considered",
        "distinct_models_considered",
        "switch_recommended",
        "final_suggestion_model",
        "policy_reason",
        "reason",
        F.array_join(
            F.transform("top_candidates", lambda c: F.concat_ws("/", c["provider"], c["model_id"])),
            " ",
        ).alias("top_models"),
        F.get("warnings", F.lit(0)).alias("warning"),
        "error",
    )


for _m in (5, 40, 100):
    QUERIES[f"slice_summary_{_m}"] = _slice_summary(_m)
    QUERIES[f"recommend_{_m}"] = _recommend(_m)


@query
def slice_proto(spark, sf):
    rows = clean.clean_benchmark_loose(view(spark, sf, "bench_raw"))
    return aggregate.tier_summary_by_model_support(rows, 40)


@query
def profiles(spark, sf):
    return aggregate.profiles(profile_rows(spark, sf)).withColumn(
        "std_accuracy", round_to(F.col("std_accuracy"), 6)
    )


@query
def profiles_overall(spark, sf):
    return aggregate.overall_profiles(profile_rows(spark, sf))


@query
def profiles_nested(spark, sf):
    nested = aggregate.nested_profiles(profile_rows(spark, sf))
    return nested.select(
        "model_id",
        "provider",
        F.col("overall.avg_accuracy").alias("overall_accuracy"),
        F.col("overall.avg_cost").alias("overall_cost"),
        F.col("overall.avg_latency_ms").alias("overall_latency_ms"),
        F.col("overall.sample_count").alias("overall_count"),
        F.explode("by_complexity").alias("prompt_complexity", "stats"),
    ).select("*", "stats.*").drop("stats")


@query
def top5_by_complexity(spark, sf):
    return aggregate.top_by_complexity(aggregate.profiles(profile_rows(spark, sf))).withColumn(
        "std_accuracy", round_to(F.col("std_accuracy"), 6)
    )


@query
def options_catalog(spark, sf):
    return aggregate.options_catalog(bench(spark, sf)).withColumn(
        "use_cases", F.array_join("use_cases", " ")
    )


@query
def class_distribution(spark, sf):
    return aggregate.class_distribution(bench(spark, sf), "prompt_complexity")


@query
def smallest_class(spark, sf):
    return aggregate.smallest_class(bench(spark, sf), "prompt_complexity")


@query
def dataset_counts(spark, sf):
    return aggregate.dataset_counts(profile_rows(spark, sf))


@query
def shortlist(spark, sf):
    summary = aggregate.supported_slices(bench(spark, sf), 5)
    return rank.shortlist(summary, TIER_SLICE).select(
        *TIER_SLICE, "model_id", "provider", "avg_accuracy", "value_score"
    )


@query
def best_value(spark, sf):
    summary = aggregate.supported_slices(bench(spark, sf), 5)
    return rank.best_value(summary, TIER_SLICE).select(
        *TIER_SLICE, "model_id", "provider", *SUMMARY, "value_score"
    )


@query
def top_candidates(spark, sf):
    return (
        ranked(spark, sf, 40)
        .where(F.col("summary_rank") <= 5)
        .select(*TIER_SLICE, "summary_rank", "model_id", "provider", *SUMMARY)
    )


@query
def composite_v1(spark, sf):
    scored = rank.composite_ranking(flat_profiles(spark, sf))
    return rank.top_recommendations(scored).select(
        "prompt_complexity",
        "rank",
        "model_id",
        "provider",
        "avg_accuracy",
        "avg_cost",
        "avg_latency_ms",
        "sample_count",
        "composite_score",
    )


@query
def composite_v0(spark, sf):
    scored = rank.mean_composite_ranking(aggregate.mean_summary(bench(spark, sf)))
    return scored.withColumn("composite_score", round_to(F.col("composite_score"), 9))


def _pairs_with_best(spark, sf, first_of_model: bool) -> DataFrame:
    """Every model of a slice as the current one, next to the best value model."""
    rows = ranked(spark, sf)
    if first_of_model:
        current = rank.current_candidates(rows, TIER_SLICE)
    else:
        current = rows.select(*TIER_SLICE, rank.rounded_stats().alias("current"))
    winners = rows.where(F.col("value_rank") == 1).select(
        *TIER_SLICE, rank.rounded_stats().alias("recommended")
    )
    return current.join(winners, TIER_SLICE).withColumns(rank.deltas())


@query
def current_deltas(spark, sf):
    return _pairs_with_best(spark, sf, True).select(
        *TIER_SLICE,
        F.col("current.model_id").alias("current_model"),
        F.col("recommended.model_id").alias("recommended_model"),
        "accuracy_delta",
        "accuracy_delta_pct",
        "cost_delta_pct",
        "latency_delta_pct",
    )


@query
def switch_policy(spark, sf):
    decided = _pairs_with_best(spark, sf, False).withColumns(rank.switch_decision(F.lit(True)))
    return decided.groupBy("policy_reason").agg(F.count(F.lit(1)).alias("row_count"))


@query
def deltas_v1(spark, sf):
    flat = flat_profiles(spark, sf)
    asked = requests(spark, sf).select("prompt_id", "complexity", "current_model")
    return rank.profile_deltas(asked, rank.composite_ranking(flat), flat)


@query
def deltas_v0(spark, sf):
    scored = rank.mean_composite_ranking(aggregate.mean_summary(bench(spark, sf)))
    asked = requests(spark, sf).select("prompt_id", "use_case", "complexity", "current_model")
    return rank.mean_deltas(asked, scored)


QUERIES["signals"] = QUERIES.pop("signals_resolved")


# Responses, batches and labels


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    return with_raw_body(view(spark, sf, "response_parts"))


def priced_responses(spark: SparkSession, sf: str) -> DataFrame:
    parsed = responses.parse_responses(raw_responses(spark, sf))
    return responses.with_cost(parsed, readers.price_table(spark))


@query
def text_extract(spark, sf):
    return responses.parse_responses(raw_responses(spark, sf)).select("resp_id", "response")


@query
def tokens(spark, sf):
    return responses.parse_responses(raw_responses(spark, sf)).select(
        "resp_id", "input_tokens", "output_tokens", "tokens"
    )


@query
def cost(spark, sf):
    return priced_responses(spark, sf).select("resp_id", "short_id", "cost")


@query
def failed_responses(spark, sf):
    _, failed = clean.split_responses(priced_responses(spark, sf))
    return failed.select("resp_id", "accuracy_score", "cost", "tokens", "reason")


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score per prompt and model; the rule stands in for a judge."""
    return priced_responses(spark, sf).groupBy("prompt_id", F.col("short_id").alias("model_id")).agg(
        F.max(F.pmod(F.char_length("response"), F.lit(101))).cast("double").alias("accuracy_score")
    )


def _bench_rows(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """Judged responses as benchmark rows, with the signals of ``asked`` (prompt_id, prompt)."""
    priced = priced_responses(spark, sf)
    named = priced.withColumns({"model_id": F.col("short_id"), "provider": F.col("fmt")})
    asked = asked.withColumn("use_case", clean.default_use_case(F.lit("reasoning")))
    attributes = signals.resolve_signals(asked).select(
        "prompt_id", F.col("complexity").alias("prompt_complexity"), "use_case", "clarity"
    )
    rows = responses.benchmark_rows(named, judge_scores(spark, sf), attributes)
    return rows.drop("prompt")


@query
def bench_rows(spark, sf):
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("prompt_id"))
    return _bench_rows(spark, sf, turns.agg(F.max_by("text", "turn").alias("prompt")))


@query
def bench_rows_asked(spark, sf):
    """Benchmark rows whose signals come from what the user asked first in a conversation."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    asked = turns.groupBy(F.col("conv_id").alias("prompt_id")).agg(F.min_by("text", "turn").alias("prompt"))
    return _bench_rows(spark, sf, asked)


@query
def allowed_models(spark, sf):
    rows = view(spark, sf, "response_parts").select(
        "resp_id",
        "short_id",
        F.when(F.col("turn") < 3, "text-generation")
        .when(F.col("turn") < 5, "code-generation")
        .otherwise("reasoning")
        .alias("use_case"),
    )
    return clean.restrict_models(rows, readers.allowed_models(spark), "short_id")


@query
def use_case_default(spark, sf):
    return prompts(spark, sf).select(
        "prompt_id", clean.default_use_case(F.col("current_model")).alias("from_model"),
        clean.default_use_case(F.concat(F.lit(" "), F.upper("use_case"))).alias("from_use_case"),
    )


@query
def request_errors(spark, sf):
    """Conversation roles and document languages as use cases and overrides."""
    asked = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "es", "poetry").otherwise(" Reasoning").alias("use_case"),
        F.when(F.col("lang") == "fr", "extreme").otherwise("LOW").alias("complexity_override"),
        F.when(F.col("lang") == "de", "").otherwise("clear").alias("clarity_override"),
    )
    return clean.validate_requests(asked)


@query
def token_batches(spark, sf):
    parsed = responses.parse_responses(raw_responses(spark, sf))
    successful, _ = clean.split_responses(parsed)
    named = successful.withColumn("model_id", F.col("short_id"))
    return labels.token_batches(named)


@query
def judge_requests(spark, sf):
    parsed = responses.parse_responses(raw_responses(spark, sf))
    successful, _ = clean.split_responses(parsed)
    named = successful.withColumn("model_id", F.col("short_id"))
    asked = (
        table(spark, sf, "conversations")
        .where(F.col("turn") == 0)
        .select(
            F.col("conv_id").alias("prompt_id"),
            F.col("text").alias("prompt"),
            F.lit("Reasoning").alias("use_case"),
        )
    )
    return labels.judge_requests(labels.token_batches(named), named, asked, "Score each response.")


@query
def judge_messages(spark, sf):
    """Requests in parts, with each conversation's first user turn as its prompt."""
    parsed = responses.parse_responses(raw_responses(spark, sf))
    successful, _ = clean.split_responses(parsed)
    named = successful.withColumn("model_id", F.col("short_id"))
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    asked = turns.groupBy(F.col("conv_id").alias("prompt_id")).agg(F.min_by("text", "turn").alias("prompt"))
    asked = asked.withColumn("use_case", F.lit("Reasoning"))
    return labels.judge_messages(
        labels.token_batches(named), named, asked, "Score each response.", most_chars=1000
    )


@query
def answers_resumed(spark, sf):
    """Labels of all prompts from two runs, of which the first cannot answer every third chunk."""
    rows = prompts(spark, sf).select("prompt_id", "prompt")
    chunked = settle(labels.fixed_chunks(rows, ["prompt_id"], 5))
    log = AnswerLog(spark, new_folder(spark), "prompt_id bigint, clarity string")

    def rule(chunk):
        length = chunk["prompt"].str.len()
        chunk["clarity"] = length.map(lambda n: "CLEAR" if n > 500 else "PARTIAL")
        return chunk

    def broken(chunk):
        if chunk["chunk"].iloc[0] % 3 == 0:
            raise ConnectionError("no answer")
        return rule(chunk)

    log.run(chunked, broken)
    log.run(chunked, rule)
    return log.answers()


@query
def chunks(spark, sf):
    return labels.fixed_chunks(prompts(spark, sf).select("prompt_id"), ["prompt_id"], 5)


@query
def chunks_relabel(spark, sf):
    return labels.fixed_chunks(prompts(spark, sf).select("prompt_id"), ["prompt_id"], 12)


@query
def label_requests(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"), "lang"
    )
    chunked = labels.fixed_chunks(docs, ["prompt_id"], 5)
    return labels.label_requests(chunked, "Classify the prompts.", ("lang",))


@query
def judge_merge(spark, sf):
    answers = view(spark, sf, "judge_outputs")
    members = answers.select(
        "batch_id", F.explode(F.array("model_a", "model_b")).alias("model_id")
    )
    return labels.merge_scores(members, answers.select("batch_id", "judge_text"))


@query
def judge_merge_prompts(spark, sf):
    """Scores per prompt of several batches, of which some answers name models of others."""
    prompt = (F.col("batch_id") % 19).alias("prompt_id")
    answers = view(spark, sf, "judge_outputs").select("*", prompt)
    members = answers.select(
        "prompt_id", "batch_id", F.explode(F.array("model_a", "model_b")).alias("model_id")
    )
    return labels.merge_prompt_scores(members, answers.select("batch_id", "judge_text"))


def _label_job(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents in chunks of five, and the labels that came back for them."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"))
    expected = labels.fixed_chunks(docs, ["prompt_id"], 5)
    sent = expected.withColumnRenamed("prompt_id", "sent_id")
    returned = view(spark, sf, "label_returns").join(sent, "sent_id")
    return expected, returned.withColumn("position", F.col("sent_id"))


@query
def label_errors(spark, sf):
    expected, returned = _label_job(spark, sf)
    as_text = F.col("prompt_id").cast("string")
    return labels.label_errors(
        expected.withColumn("prompt_id", as_text), returned.withColumn("prompt_id", as_text)
    )


@query
def label_missing(spark, sf):
    expected, returned = _label_job(spark, sf)
    found = labels.label_missing(expected.withColumn("position", F.col("prompt_id")), returned, most=3)
    return found.select("chunk", "missing_count", F.array_join("missing_ids", ",").alias("missing_ids"), "error")


@query
def label_attach(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    returned = view(spark, sf, "label_returns").withColumn("clarity", F.upper("clarity"))
    return labels.attach_labels(docs, returned)


@query
def pending(spark, sf):
    return labels.pending(prompts(spark, sf), view(spark, sf, "labelled")).select(
        "prompt_id", "use_case"
    )


@query
def pending_first(spark, sf):
    return labels.pending(prompts(spark, sf), view(spark, sf, "labelled"), 100).select(
        "prompt_id", "use_case"
    )


@query
def labeller(spark, sf):
    """A user labeller over pandas batches: the rule counts characters."""

    def rule(batch):
        length = batch["prompt"].str.len()
        batch["clarity"] = length.map(lambda n: "CLEAR" if n > 500 else "PARTIAL")
        return batch[["prompt_id", "clarity"]]

    rows = prompts(spark, sf).select("prompt_id", "prompt")
    return labels.label_with(rows, rule, "prompt_id bigint, clarity string")


@query
def enriched_prompts(spark, sf):
    asked = signals.with_heuristics(prompts(spark, sf))
    return asked.select(
        "prompt_id",
        labels.enriched_prompt(
            F.col("prompt"), F.col("heuristic_complexity"), F.col("prompt_id") % 101
        ).alias("enriched"),
    )


# Sources


@query
def ingest_report(spark, sf):
    return readers.prompt_file_report(view(spark, sf, "prompt_files"))


@query
def ingest_total(spark, sf):
    return readers.job_total(readers.prompt_file_report(view(spark, sf, "prompt_files")))


@query
def benchmark_csv(spark, sf):
    """Benchmark files of two column orders, with responses over several lines."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 26).cast("string")).alias("model_id"),
        F.concat(F.lit('"'), "text", F.lit(" ")).alias("response"),
        F.col("n_chars").cast("string").alias("tokens"),
        F.col("lang").alias("remark"),
    )
    path = new_folder(spark)
    is_even = F.col("id").cast("bigint") % 2 == 0
    writers.write_prompts(rows.where(is_even), f"{path}/a", ["id", "model_id", "response", "tokens"])
    writers.write_prompts(rows.where(~is_even), f"{path}/b", ["remark", "response", "id", "model_id"])
    read = readers.read_benchmark_csv(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"])
    return read.select("id", "model_id", "response", "tokens", "provider")


@query
def models_used(spark, sf):
    """Rows and full model ids of the models that have answered."""
    models = readers.model_catalogue(spark, "profile/")
    used = view(spark, sf, "response_parts").groupBy("short_id").agg(F.count(F.lit(1)).alias("row_count"))
    return used.join(F.broadcast(models), "short_id").select("short_id", "source", "model_id", "row_count")


@query
def ingest_prompts(spark, sf):
    return readers.ingest_prompts(
        view(spark, sf, "prompt_files"), "reasoning", "mid", strict=False
    ).select(
        "file_name", "row_pos", "prompt", "clarity", "prompt_complexity", "use_case"
    )


@query
def clarity_input(spark, sf):
    rows = number_rows(
        view(spark, sf, "prompt_files").withColumnRenamed("row_pos", "source_order"),
        ["source_order"],
        ["file_name"],
        "row_pos",
    )
    return readers.ingest_clarity_input(rows)


@query
def relabel_input(spark, sf):
    rows = prompts(spark, sf).select(
        F.col("prompt_id").alias("row_pos"),
        F.concat(F.lit("\n "), "prompt").alias("prompt"),
        F.when(F.col("current_model") == "absent-model", "poetry")
        .otherwise(F.upper("use_case"))
        .alias("use_case"),
        F.lit(" clear").alias("clarity"),
        F.lit("High ").alias("prompt_complexity"),
    )
    return clean.clean_relabel_input(rows)


@query
def distinct_prompts(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("text").alias("prompt"),
        F.when(F.col("lang") == "en", "LOW")
        .when(F.col("lang") == "de", " mid")
        .otherwise("none")
        .alias("prompt_complexity"),
    )
    return clean.distinct_labelled_prompts(rows)


@query
def source_fallback(spark, sf):
    rows = bench(spark, sf)
    merged = readers.with_fallback(readers.scan_benchmark(rows, use_case="reasoning"), rows)
    return merged.groupBy("use_case", "data_source").agg(F.count(F.lit(1)).alias("row_count"))


@query
def scan_filtered(spark, sf):
    rows = readers.scan_benchmark(bench(spark, sf), "reasoning", "mid", "CLEAR")
    return rows.select("src_id", "model_id", "accuracy_score")


@query
def scan_stored(spark, sf):
    path = new_folder(spark)
    writers.append_benchmark(bench(spark, sf).select(*BENCH), path)
    stored = readers.read_benchmark_table(spark, path)
    return readers.scan_benchmark(stored, "reasoning", "mid", "CLEAR").select(
        "src_id", "model_id", "accuracy_score"
    )


@query
def logs_filtered(spark, sf):
    rows = readers.scan_prompt_logs(clean.clean_prompt_logs(logs(spark, sf)), use_case="reasoning")
    return rows.select("prompt", "use_case", "clarity")


@query
def provider_checks(spark, sf):
    checks = view(spark, sf, "response_parts").select(
        F.col("fmt").alias("source"), (F.col("response") != "").alias("passed")
    )
    return aggregate.provider_checks(checks)


@query
def provider_order(spark, sf):
    models = readers.model_catalogue(spark)
    used = view(spark, sf, "response_parts").join(F.broadcast(models), "short_id", "left")
    return (
        used.groupBy("provider")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("provider_rank", aggregate.provider_rank(F.col("provider")))
    )


@query
def requests_without_data(spark, sf):
    """Requests of a use case that no benchmark row has."""
    known = bench(spark, sf).where(F.col("use_case") != "reasoning")
    answers = recommend(prompts(spark, sf), known, logs(spark, sf), tell_no_data=True)
    lacking = answers.where(F.col("error") == policy.ERROR_NO_DATA)
    return lacking.select("prompt_id", "use_case", "recommended_model", "error")


@query
def catalog_by_use_case(spark, sf):
    options = aggregate.options_catalog(bench(spark, sf))
    return clean.filter_catalog(options, "reasoning").select("model_id", "provider", "sample_count")


# Sinks, each written to the shared folder and read back


@query
def benchmark_written(spark, sf):
    path = new_folder(spark)
    writers.append_benchmark(bench(spark, sf).select(*BENCH), path)
    return spark.read.parquet(path).select(*BENCH)


@query
def logs_written(spark, sf):
    path = new_folder(spark)
    writers.append_prompt_logs(clean.clean_prompt_logs(logs(spark, sf)), path)
    return spark.read.parquet(path)


@query
def chunks_written(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"),
        F.concat(F.lit(" "), "text", F.lit('\n"')).alias("prompt"),
        F.when(F.col("lang") == "en", "CLEAR").otherwise("PARTIAL").alias("clarity"),
    )
    path = new_folder(spark)
    writers.write_chunks(labels.fixed_chunks(docs, ["prompt_id"], 5), path)
    return readers.read_chunks(spark, path)


@query
def profiles_written(spark, sf):
    path = new_folder(spark)
    writers.write_profiles(aggregate.nested_profiles(profile_rows(spark, sf)), path)
    return profile_plans.flatten_profiles(readers.read_profiles(spark, path))


@query
def relabelled_written(spark, sf):
    asked = signals.with_heuristics(prompts(spark, sf))
    path = new_folder(spark)
    rows = asked.select(
        "prompt",
        "use_case",
        F.col("heuristic_complexity").alias("prompt_complexity"),
        F.col("heuristic_clarity").alias("clarity"),
        F.lit("mid").alias("old_prompt_complexity"),
        F.concat(F.lit("words and markers: "), "heuristic_complexity").alias("complexity_reason"),
    )
    writers.append_relabelled(rows, path, "rules:1")
    return spark.read.parquet(path)


@query
def prompt_csv(spark, sf):
    """Prompt files of two column orders, one with a column more, read by their headers."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit(" "), "text", F.lit('\r\n"')).alias("prompt"),
        F.when(F.col("lang") == "en", "clear").otherwise("partial").alias("clarity"),
        "source",
    )
    path = new_folder(spark)
    is_even = F.col("id").cast("bigint") % 2 == 0
    writers.write_prompts(rows.where(is_even), f"{path}/a", ["id", "prompt", "clarity"])
    writers.write_prompts(rows.where(~is_even), f"{path}/b", ["clarity", "source", "prompt", "id"])
    read = readers.read_prompt_files(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"])
    return read.select("id", "prompt", "clarity", "source")


# Classification


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return classify.training_rows(
        table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label")),
        "text",
        "label",
    )


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf)
    terms = settle(classify.document_terms(docs), codec="zstd")
    return terms, classify.vocabulary(terms, docs.count())


@query
def tfidf_vocabulary(spark, sf):
    docs = _documents(spark, sf)
    vocab = classify.vocabulary(classify.document_terms(docs), docs.count())
    return vocab.select(
        "term",
        "doc_freq",
        "term_freq",
        round_to(F.col("idf"), 9).alias("idf"),
        F.col("index").cast("bigint").alias("term_index"),
    )


@query
def tfidf_weights(spark, sf):
    terms, vocab = _terms(spark, sf)
    weights = classify.term_weights(terms, vocab)
    discard(terms)  # the weights are made of written blocks
    return weights.select(
        "doc_id", "term", round_to(F.col("weight"), 6).alias("weight")
    )


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
        F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"),
    )


@query
def confusion(spark, sf):
    return classify.confusion(_rated(spark, sf), "label", "predicted")


@query
def class_report(spark, sf):
    return classify.class_report(_rated(spark, sf), "label", "predicted")


@query
def overall_report(spark, sf):
    return classify.overall_report(_rated(spark, sf), "label", "predicted")


@query
def stratified_folds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return classify.stratified_folds(rows, "lang", "doc_id", 5)


@query
def stratified_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return classify.stratified_split(rows, "lang", "doc_id")


@query
def classifier_scores(spark, sf):
    docs = _documents(spark, sf)
    path = new_folder(spark)
    classify.train(docs).save(path)
    model = classify.TextClassifier.load(spark, path)
    return model.score(docs).select("doc_id", "label", "predicted", "confidence")


@query
def classifier_folds(spark, sf):
    return classify.cross_validate(_documents(spark, sf), max_features=FOLD_FEATURES)


@query
def fold_vocabularies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    placed = settle(classify.stratified_folds(docs, "lang", "doc_id", 5))
    terms = settle(classify.document_terms(placed, "doc_id", "text", ("fold",)))
    sizes = placed.groupBy("fold").agg(F.count(F.lit(1)).alias("row_count"))
    return classify.fold_vocabularies(terms, sizes).select(
        "fold", "term", "doc_freq", "term_freq", round_to(F.col("idf"), 9).alias("idf"), F.col("index").cast("bigint").alias("term_index")
    )


@query
def linear_scores(spark, sf):
    """A model whose weights are the logs of how many documents of a language have a term."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    terms = classify.document_terms(docs, "doc_id", "text", ("lang",))
    total = docs.count()
    classes = settle(docs.groupBy(F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n")))
    names = [F.lit(r["class"]).cast("string") for r in classes.select("class").collect()]  # few classes
    # A term moves once, with a count per class.
    of_class = [F.count_if(F.col("lang").eqNullSafe(name)).alias(f"_n{k}") for k, name in enumerate(names)]
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("term_freq"), *of_class)
    numbered = settle(classify.counted_vocabulary(counted, total), lean=True)
    vocab = numbered.drop(*(f"_n{k}" for k in range(len(names))))
    counts = F.array(*[F.struct(name.alias("class"), F.col(f"_n{k}").alias("n")) for k, name in enumerate(names)])
    coefficients = numbered.select("term", F.inline(counts)).where(F.col("n") > 0).select("term", "class", F.log(F.col("n") + 1.0).alias("weight"))
    intercepts = classes.select("class", F.log(F.col("n") / F.lit(total)).alias("intercept"))
    path = new_folder(spark)
    classify.TermModel(vocab, coefficients, intercepts).save(path)
    scored = classify.TermModel.load(spark, path).score(docs)
    return scored.select("doc_id", "predicted", round_to(F.col("confidence"), 6).alias("confidence"))


@query
def linear_report(spark, sf):
    """How well the linear model tells the languages it was made from."""
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    scored = linear_scores(spark, sf).join(langs, "doc_id")
    return classify.class_report(scored, "lang", "predicted")


# Streams


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of job events."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"events_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(name)
    return spark.sql(view_sql("job_events", {"events": name}))


def _streamed(
    spark: SparkSession, sf: str, roll_up, keys: list[str], mode: str = "update"
) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rolled = roll_up(event_stream(spark, sf))
    store = UpdateStore(spark, f"{folder}/rows", rolled.schema, keys)
    store.write_stream(rolled, f"{folder}/checkpoint", mode)
    return store.read()


DELIVERIES = 4


def _delivered(spark: SparkSession, sf: str, folder: str, repeats: bool) -> Iterator[DataFrame]:
    """The job events as a stream, in as many deliveries by time; each yields the stream anew.

    Deliveries overlap by half an hour where ``repeats`` is set, and the last has a copy of
    all events under other ids from long before, which the watermark is to keep out.
    """
    events = view(spark, sf, "job_events").withColumn("ts", F.col("ts").cast("timestamp"))
    shares = [i / DELIVERIES for i in range(1, DELIVERIES)]
    bounds = events.agg(F.percentile_approx(F.unix_micros("ts"), shares, 10_000)).first()[0] or []
    at, half_hour = F.unix_micros("ts"), 30 * 60 * 1_000_000
    for k in range(len(bounds) + 1):
        low = bounds[k - 1] - (half_hour if repeats else 0) if k else None
        rows = events if low is None else events.where(at > low)
        rows = rows.where(at <= bounds[k]) if k < len(bounds) else rows
        if k and k == len(bounds):
            old = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 400 DAYS"))
            rows = rows.unionByName(old.withColumn("event_id", F.col("event_id") + 10**12))
        rows.write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(events.schema).parquet(f"{folder}/in")


def _bounded(spark: SparkSession, sf: str, roll_up: rollups.RollUp) -> DataFrame:
    """A roll-up whose stream starts anew for each delivery of repeated and late events."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for stream in _delivered(spark, sf, folder, repeats=True):
        bounded = rollups.BoundedRollUp(stream, roll_up, folder)
        bounded.run()
    return bounded.rows()


@query
def job_progress(spark, sf):
    return _streamed(spark, sf, jobs.job_progress, ["job_id"])


@query
def job_status(spark, sf):
    return _streamed(spark, sf, jobs.job_status, ["job_id"])


@query
def job_failures(spark, sf):
    def pick(events):
        return jobs.failures(events).select("event_id", "job_id", "model_id", "prompt_index")

    return _streamed(spark, sf, pick, ["event_id"], "append")


@query
def job_starts(spark, sf):
    return _streamed(spark, sf, jobs.job_starts, ["job_id"])


@query
def file_lifecycle(spark, sf):
    return _streamed(spark, sf, jobs.file_lifecycle, ["job_id", "file_index"])


@query
def chunk_lifecycle(spark, sf):
    return _streamed(spark, sf, jobs.chunk_lifecycle, ["job_id", "chunk_index"])


@query
def events_until_end(spark, sf):
    return jobs.until_terminal(view(spark, sf, "job_events")).select("event_id", "job_id", "type")


@query
def job_progress_bounded(spark, sf):
    return _bounded(spark, sf, rollups.JOB_PROGRESS)


@query
def job_status_bounded(spark, sf):
    return _bounded(spark, sf, rollups.JOB_STATUS)


@query
def file_lifecycle_bounded(spark, sf):
    return _bounded(spark, sf, rollups.FILE_LIFECYCLE)


@query
def chunk_lifecycle_bounded(spark, sf):
    return _bounded(spark, sf, rollups.CHUNK_LIFECYCLE)


@query
def events_until_end_stream(spark, sf):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    provider = spark.conf.get(key)
    spark.conf.set(key, ending.PROVIDER)
    try:
        for stream in _delivered(spark, sf, folder, repeats=False):
            # The ends are kept for longer than the events of the table span.
            ended = ending.until_end(stream.select("event_id", "ts", "job_id", "type"), keep_hours=24 * 60)
            store = UpdateStore(spark, f"{folder}/rows", ended.schema)
            store.write_stream(ended, f"{folder}/checkpoint", "append")
    finally:
        spark.conf.set(key, provider)
    return store.read().select("event_id", "job_id", "type")


@query
def chunks_forwarded(spark, sf):
    """Finished chunks of prompts, in two deliveries, as benchmark rows of their judged answers."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    clarity = F.when(F.col("lang") == "en", " clear").when(F.col("lang") == "fr", "odd").otherwise("Partial")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"), clarity.alias("clarity"))
    judged = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def to_benchmark(batch: DataFrame) -> DataFrame:
        prompts = readers.check_prompt_rows(batch).where("is_valid")
        score = (F.col("quality") * 100).cast("double").alias("accuracy_score")
        model = F.concat(F.lit("m"), (F.col("doc_id") % 26).cast("string")).alias("model_id")
        return prompts.join(judged, "doc_id").select("doc_id", "clarity", model, score)

    schema = "doc_id bigint, clarity string, model_id string, accuracy_score double"
    store = UpdateStore(spark, f"{folder}/rows", StructType.fromDDL(schema))
    for part in range(2):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        store.write_stream(stream, f"{folder}/checkpoint", "append", to_benchmark)
    return store.read()


@query
def events_by_complexity(spark, sf):
    events = clean.filter_events(view(spark, sf, "job_events"), "mid")
    return events.select("event_id", "job_id", "type")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
