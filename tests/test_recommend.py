import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.operators import aggregate, clean, rank, signals
from benchsieve.plans.profiles import build_profiles, flatten_profiles, recommend_by_profile
from benchsieve.plans.recommend import recommend
from benchsieve.policy import Policy
from benchsieve.sources.readers import with_fallback

BENCH = (
    "model_id string, provider string, use_case string, prompt_complexity string, clarity string, "
    "accuracy_score double, cost double, latency_ms double"
)
USE, CX, CL = "reasoning", "low", "CLEAR"


def bench_rows(models, n=5, use_case=USE, complexity=CX, clarity=CL):
    return [
        (m, p, use_case, complexity, clarity, a, c, l)
        for m, p, a, c, l in models
        for _ in range(n)
    ]


def ask(spark, bench, current, **columns):
    row = {"prompt": "x", "use_case": USE, "current_model": current,
           "complexity_override": CX, "clarity_override": CL, **columns}
    requests = spark.createDataFrame([row], ", ".join(f"{c} string" for c in row))
    return recommend(requests, spark.createDataFrame(bench, BENCH)).collect()[0]


@pytest.mark.parametrize(
    "best, current, reason, switch",
    [
        # A gain of exactly 2 is enough.
        ((82.0, 10.0, 100.0), (80.0, 1.0, 1.0), policy.REASON_ACCURACY, True),
        # Cost falls by exactly 15 percent, accuracy by exactly 1.
        ((89.0, 85.0, 100.0), (90.0, 100.0, 100.0), policy.REASON_COST, True),
        # Cost falls, but accuracy falls by more than 1.
        ((88.5, 85.0, 100.0), (90.0, 100.0, 100.0), policy.REASON_STAY, False),
        # Latency falls by exactly 20 percent.
        ((90.0, 100.0, 80.0), (90.0, 100.0, 100.0), policy.REASON_LATENCY, True),
        # Nearly the same.
        ((90.0, 99.0, 99.0), (90.0, 100.0, 100.0), policy.REASON_STAY, False),
        # The current cost is zero, so there is no percentage.
        ((90.0, 0.0, 80.0), (90.0, 0.0, 100.0), policy.REASON_LATENCY, True),
    ],
)
def test_switch_rules(spark, best, current, reason, switch):
    columns = "avg_accuracy double, median_cost double, median_latency_ms double"
    pair = spark.createDataFrame([(best, current)], f"recommended struct<{columns.replace(' double', ':double')}>, current struct<{columns.replace(' double', ':double')}>")
    row = pair.withColumns(rank.deltas()).withColumns(rank.switch_decision(F.lit(True))).first()
    assert (row.policy_reason, row.switch_recommended) == (reason, switch)
    if current[1] == 0:
        assert row.cost_delta_pct is None


def test_absent_current_model_and_texts(spark):
    row = ask(spark, bench_rows([("a", "p", 90.0, 2.0, 5.0)]), "gone")
    assert row.switch_recommended and row.policy_reason == policy.REASON_NO_CURRENT
    assert row.reason.startswith("p/a is the best value option in the exact benchmark slice.")
    assert row.warnings == [
        "Current model 'gone' was not found in the matched benchmark slice, "
        "so comparison deltas were skipped."
    ]
    assert row.accuracy_delta is None and row.current_model_stats is None
    assert row.final_suggestion_model == "a"


def test_value_is_scaled_within_the_shortlist(spark):
    models = [
        ("good", "p", 90.0, 10.0, 10.0),
        ("cheap", "p", 88.5, 1.0, 20.0),
        ("far", "p", 60.0, 0.0, 0.0),
    ]
    row = ask(spark, bench_rows(models), "good")
    assert row.recommended_model == "cheap" and row.models_considered == 3
    assert [c.model_id for c in row.top_candidates] == ["good", "cheap", "far"]
    flat = ask(spark, bench_rows([(m, "p", 90.0, 3.0, 3.0) for m in ("b", "a")]), "b")
    assert flat.recommended_model == "a" and flat.policy_reason == policy.REASON_STAY


def test_tiers_fall_back_and_end_in_an_error(spark):
    rows = bench_rows([("a", "p", 90.0, 2.0, 5.0)], 3)
    rows += bench_rows([("a", "p", 80.0, 2.0, 5.0)], 2, clarity="PARTIAL")
    assert ask(spark, rows, "a").filter_level == "use_case_plus_complexity"
    rows = bench_rows([("a", "p", 90.0, 2.0, 5.0)], 3)
    rows += bench_rows([("a", "p", 80.0, 2.0, 5.0)], 3, complexity="high")
    found = ask(spark, rows, "a")
    assert (found.filter_level, found.slice_row_count) == ("use_case_only", 6)
    row = ask(spark, bench_rows([("a", "p", 90.0, 2.0, 5.0)], 4), "a")
    assert row.filter_level == "none" and row.error == policy.ERROR_NO_SLICE
    bad = ask(spark, rows, "a", use_case="poetry")
    assert bad.error == "Unsupported use_case 'poetry'." and bad.recommended_model is None


def expected_answer(rows, use_case, complexity, clarity, current, least):
    """A plain reading of the policy for one request."""
    tiers = [
        ("exact", lambda r: r[3] == complexity and r[4] == clarity),
        ("use_case_plus_complexity", lambda r: r[3] == complexity),
        ("use_case_only", lambda r: True),
    ]
    for name, keep in tiers:
        chosen = [r for r in rows if r[2] == use_case and keep(r)]
        stats = []
        for key in {(r[0], r[1]) for r in chosen}:
            of = [r for r in chosen if (r[0], r[1]) == key]
            if len(of) >= least:
                stats.append((-statistics.fmean(r[5] for r in of), -len(of),
                              statistics.median(r[6] for r in of),
                              statistics.median(r[7] for r in of), *key))
        if stats:
            break
    else:
        return None
    stats.sort()
    top = [s for s in stats if -s[0] >= -stats[0][0] - 2.0]

    def share(s, i):
        low, high = min(t[i] for t in top), max(t[i] for t in top)
        return 1.0 if high == low else 1 - (s[i] - low) / (high - low)

    best = min(top, key=lambda s: (-(0.75 * share(s, 2) + 0.25 * share(s, 3)), s))
    mine = next((s for s in stats if s[4] == current), None)
    gain = None if mine is None else round(round(-best[0], 2) - round(-mine[0], 2), 2)
    return name, best[4], best[5], len(chosen), len(stats), gain


def test_batch_equals_one_by_one_reading(spark):
    rng = random.Random(11)
    rows = [
        (f"m{rng.randrange(6)}", rng.choice(["p", "q", ""]), rng.choice(policy.USE_CASES[:2]),
         rng.choice(policy.COMPLEXITIES), rng.choice(policy.CLARITIES),
         float(rng.randrange(320, 340)) / 4, rng.randrange(100) / 4, rng.randrange(1000) / 4)
        for _ in range(500)
    ]
    asked = [
        (i, "x", rng.choice(policy.USE_CASES), f"m{rng.randrange(8)}",
         rng.choice(policy.COMPLEXITIES), rng.choice(policy.CLARITIES))
        for i in range(60)
    ]
    requests = spark.createDataFrame(
        asked, "id int, prompt string, use_case string, current_model string, "
        "complexity_override string, clarity_override string"
    )
    for least in (3, 9):
        answers = recommend(
            requests, spark.createDataFrame(rows, BENCH), rules=Policy(min_samples=least)
        ).collect()
        assert len(answers) == len(asked)
        by_id = {a.id: a for a in answers}
        for i, _, use_case, current, complexity, clarity in asked:
            wanted = expected_answer(rows, use_case, complexity, clarity, current, least)
            a = by_id[i]
            got = (a.filter_level, a.recommended_model, a.recommended_provider,
                   a.slice_row_count, a.models_considered, a.accuracy_delta)
            assert (got == wanted) if wanted else (a.error == policy.ERROR_NO_SLICE)


def heuristic(prompt):
    low = prompt.lower()
    words = len(re.findall(r"\w+", low))

    def has(tokens):
        return any(t in low for t in tokens)

    if words <= 10 and not has(policy.NOT_LOW_TOKENS):
        complexity = "low"
    elif has(policy.HIGH_TOKENS) or words >= 45:
        complexity = "high"
    else:
        complexity = "mid"
    words = len(re.findall(r"\w+", prompt))
    task = has(policy.TASK_VERBS)
    if words <= 3 or has(policy.AMBIGUOUS_MARKERS):
        clarity = "UNCLEAR"
    elif task and (has(policy.CONSTRAINT_MARKERS) or words >= 8):
        clarity = "CLEAR"
    elif task or words >= 6:
        clarity = "PARTIAL"
    else:
        clarity = "UNCLEAR"
    return complexity, clarity


def test_heuristics(spark):
    prompts = ["hello", "", "Explain this now please", "fetch the data for me today ok",
               "Write a poem with rhymes", "Write a short poem", "one two three four five six",
               "word " * 44, "word " * 45, "Design a system", "Compare A and B", "İ İ İ",
               "a b c d e f g h i j k", "make a multi-tenant thing of it all for a b c d"]
    df = spark.createDataFrame([(p,) for p in prompts], "prompt string")
    for r in signals.with_heuristics(df).collect():
        assert (r.heuristic_complexity, r.heuristic_clarity) == heuristic(r.prompt), r.prompt


def test_clarity_votes_and_sources(spark):
    logs = spark.createDataFrame(
        [("Tie it", USE, "unclear"), ("Tie it", USE, " PARTIAL "), ("Tie it", USE, "bogus"),
         ("  NORM   only", "Reasoning ", "CLEAR"), ("other", "code-generation", "CLEAR"),
         (None, USE, "CLEAR")],
        "prompt string, use_case string, clarity string",
    )
    requests = spark.createDataFrame(
        [("Tie it", USE, None, None), ("norm only", USE, None, None), ("other", USE, None, None),
         ("Tie it", USE, "low", "CLEAR")],
        "prompt string, use_case string, complexity_override string, clarity_override string",
    )
    rows = signals.resolve_signals(requests, logs).collect()
    got = sorted((r.prompt, r.clarity, r.clarity_source, r.complexity_source) for r in rows)
    assert got == [
        ("Tie it", "CLEAR", "manual_override", "manual_override"),
        ("Tie it", "PARTIAL", "prompt_logs_exact", "heuristic"),
        ("norm only", "CLEAR", "prompt_logs_local_exact", "heuristic"),
        ("other", "UNCLEAR", "heuristic", "heuristic"),
    ]


def test_classifier_label_ranks_between_override_and_heuristic(spark):
    requests = spark.createDataFrame(
        [("hello", USE, " HIGH", 0.98765), ("hello", USE, "odd", 0.5)],
        "prompt string, use_case string, predicted_complexity string, predicted_confidence double",
    )
    rows = signals.resolve_signals(requests).collect()
    got = {(r.complexity, r.complexity_source, r.complexity_confidence) for r in rows}
    assert got == {("high", "classifier", 0.988), ("low", "heuristic", None)}


def test_profiles_and_composite(spark):
    # Published profile numbers of a few models for short prompts.
    rows = [("nova-lite", "Amazon", 92.86, 0.00009, 2379.5, 36),
            ("steady", "A", 92.86, 0.00009, 2379.5, 2),
            ("costly", "B", 91.9, 0.0103, 32895.5, 20),
            ("middle", "C", 85.0, 0.001, 5000.0, 30)]
    flat = spark.createDataFrame(
        [(m, p, "low", a, c, l, n) for m, p, a, c, l, n in rows],
        "model_id string, provider string, prompt_complexity string, avg_accuracy double, "
        "avg_cost double, avg_latency_ms double, sample_count bigint",
    )
    requests = spark.createDataFrame(
        [("low", "costly"), ("low", None), ("high", "x")], "complexity string, current_model string"
    )
    answers = {
        (r.complexity, r.current_model): r for r in recommend_by_profile(requests, flat).collect()
    }
    known = answers[("low", "costly")]
    assert known.to_model == "nova-lite" and known.from_model == "costly"
    assert (known.accuracy_delta, known.cost_delta_pct) == (0.96, -99.1)
    assert known.latency_delta_ms == -30516.0 and known.all_models_count == 3
    # By hand: middle 0.25 * 0.910872 + 0.25 * 0.914127, costly 0.5 * 0.877863.
    assert [r.model_id for r in known.recommendations] == ["nova-lite", "middle", "costly"]
    assert [r.composite_score for r in known.recommendations] == [1.0, 0.4562, 0.4389]
    assert answers[("low", None)].from_model == "costly"
    assert answers[("high", "x")].error == "No model data available for 'high' complexity"


def test_nested_profiles_keep_last_provider_numbers(spark):
    columns = ("model_id string, provider string, prompt_complexity string, accuracy_score string, "
               "cost string, latency_ms string, tokens string")
    first = spark.createDataFrame(
        [("m", "a", " LOW", "80", "1", "10", "5"), ("m", "b", "low", "90", "2", None, "x"),
         ("m", "b", "low", "70", "2", "20", "7"), ("m", None, "low", "1", "1", "1", "1"),
         ("m", "b", "low", "bad", "1", "1", "1")], columns)
    second = spark.createDataFrame([("n", "a", "high", "50")], "model_id string, provider string, "
                                   "prompt_complexity string, accuracy_score string")
    documents = build_profiles([first, second])
    by_model = {d.model_id: d for d in documents.collect()}
    low = by_model["m"].by_complexity["low"]
    assert by_model["m"].provider == "a" and by_model["m"].overall.sample_count == 1
    assert (low.avg_accuracy, low.sample_count, low.median_accuracy) == (80.0, 2, 80.0)
    assert (low.std_accuracy, low.avg_latency_ms, low.avg_tokens) == (14.14, 20.0, 7.0)
    assert by_model["n"].by_complexity["high"].std_accuracy == 0.0
    assert by_model["n"].by_complexity["high"].avg_cost is None
    assert flatten_profiles(documents).count() == 2


def test_support_by_model_id_keeps_small_provider_groups(spark):
    rows = bench_rows([("a", "p", 90.0, 2.0, 5.0)], 4) + bench_rows([("a", "q", 50.0, 2.0, 5.0)], 1)
    rows += bench_rows([("b", "p", 90.0, 2.0, 5.0)], 4)
    kept = aggregate.tier_summary_by_model_support(spark.createDataFrame(rows, BENCH), 5).collect()
    assert {(r.model_id, r.provider, r.slice_row_count) for r in kept} == {("a", "p", 5), ("a", "q", 5)}


def test_cleaning_rules(spark):
    raw = spark.createDataFrame(
        [(" m ", None, " Reasoning", "LOW ", "clear", "1_0", "2", "3"),
         (None, "p", USE, "low", "CLEAR", "1", "2", "3"),
         ("m", "p", USE, "extreme", "CLEAR", "1", "2", "3"),
         ("m", "p", USE, "low", "CLEAR", "nan", "2", "3"),
         ("", "p", "", "odd", "ODD", "1", "2", "3")],
        "model_id string, provider string, use_case string, prompt_complexity string, "
        "clarity string, accuracy_score string, cost string, latency_ms string",
    )
    assert [tuple(r) for r in clean.clean_benchmark(raw).select(*clean.KEYS, *clean.METRICS).collect()] == [
        ("m", "", "reasoning", "low", "CLEAR", 10.0, 2.0, 3.0)
    ]
    assert clean.clean_benchmark_loose(raw).count() == 3


def test_source_fallback_is_decided_per_use_case(spark):
    primary = spark.createDataFrame(bench_rows([("a", "p", 1.0, 1.0, 1.0)], 1), BENCH)
    local = spark.createDataFrame(
        bench_rows([("b", "p", 1.0, 1.0, 1.0)], 2)
        + bench_rows([("c", "p", 1.0, 1.0, 1.0)], 3, use_case="code-generation"), BENCH)
    merged = with_fallback(primary, local)
    got = {(r.model_id, r.data_source): r["count"] for r in merged.groupBy("model_id", "data_source").count().collect()}
    assert got == {("a", "primary"): 1, ("c", "local_csv"): 3}
    requests = spark.createDataFrame([("x", "code-generation", "c")], "prompt string, use_case string, current_model string")
    assert recommend(requests, merged, rules=Policy(min_samples=1)).first().data_source == "local_csv"


def test_use_cases_without_data_are_told_apart(spark):
    rows = spark.createDataFrame([("a", "p", "reasoning", "low", "CLEAR", 90.0, 1.0, 5.0)] * 3, BENCH)
    asked = [(1, "x", "reasoning", "a", "low", "CLEAR"), (2, "x", "code-generation", "a", "low", "CLEAR"), (3, "x", "poetry", "a", "low", "CLEAR")]
    requests = spark.createDataFrame(asked, "id int, prompt string, use_case string, current_model string, complexity_override string, clarity_override string")
    found = {r.id: r.error for r in recommend(requests, rows, tell_no_data=True).collect()}
    assert found[1] == policy.ERROR_NO_SLICE and found[2] == policy.ERROR_NO_DATA and "poetry" in found[3]


def test_log_votes_move_digests_and_not_texts(spark):
    from benchsieve.operators.signals import clarity_from_logs

    asked = spark.createDataFrame(
        [(1, "Write  it", "reasoning"), (2, " write it ", "reasoning"), (3, None, "reasoning"), (4, "Write  it", None), (5, "other", "reasoning")],
        "id int, prompt string, use_case string",
    )
    logs = spark.createDataFrame(
        [("Write  it", "reasoning", "clear"), ("write IT", " Reasoning", "unclear"), ("WRITE it", "reasoning", "unclear"), (None, "reasoning", "clear")],
        "prompt string, use_case string, clarity string",
    )
    found = clarity_from_logs(asked, logs)
    got = {r.id: (r._clarity_exact, r._clarity_normalised) for r in found.collect()}
    assert got == {1: ("CLEAR", "UNCLEAR"), 2: (None, "UNCLEAR"), 3: (None, None), 4: (None, None), 5: (None, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = found.select("id", "_clarity_exact", "_clarity_normalised")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "prompt" in line]
    # What each join is keyed by does not have the text itself.
    assert not [line for line in plan.splitlines() if "Join" in line and "prompt" in line]
