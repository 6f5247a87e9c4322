import json
import random

import pytest
from pyspark.sql import functions as F

from benchsieve.functions.numbering import running_sums
from benchsieve.operators import clean, labels, responses
from benchsieve.operators.answers import AnswerLog
from benchsieve.sources.readers import allowed_models, price_table


def greedy(items, budget, excerpt):
    """Batches of (resp_id, model_id, text), one after the other."""
    batches, current, used = {}, 1, 0
    is_open = False
    for resp_id, model_id, text in sorted(items, key=lambda i: (len(i[2]), i[1], i[0])):
        tokens = len(text[:excerpt]) // 4
        if is_open and used + tokens > budget:
            current, used = current + 1, 0
        batches[resp_id] = current
        used, is_open = used + tokens, True
    return batches


@pytest.mark.parametrize("budget, excerpt", [(3000, None), (700, None), (3000, 3000), (20, 200), (3, 40)])
def test_token_batches_equal_the_greedy_walk(spark, budget, excerpt):
    rng = random.Random(budget)
    rows = []
    for i in range(600):
        prompt = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
        length = rng.choice([1, 2, 3, 39, 40, rng.randrange(1, 300), 3100, 3000, 2999, 13_000, 14_000])
        rows.append((prompt, i, f"m{rng.randrange(5)}", "é" * length))
    df = spark.createDataFrame(rows, "prompt_id int, resp_id int, model_id string, response string")
    got = {r.resp_id: r.batch for r in labels.token_batches(df, budget, excerpt).collect()}
    expected = {}
    for prompt in {r[0] for r in rows}:
        expected |= greedy([r[1:] for r in rows if r[0] == prompt], budget, excerpt)
    assert got == expected


def test_fixed_chunks(spark):
    df = spark.range(23).withColumn("prompt_id", F.col("id") * 3).repartition(5)
    got = {r.id: r.chunk for r in labels.fixed_chunks(df, ["prompt_id"], 5).collect()}
    assert got == {i: i // 5 + 1 for i in range(23)}


def test_judge_request_text(spark):
    batches = spark.createDataFrame(
        [(1, 2, "b", 5, 1), (1, 1, "a", 2, 1)],
        "prompt_id int, resp_id int, model_id string, tokens bigint, batch bigint")
    replies = spark.createDataFrame([(1, "one"), (2, "two" * 5000)], "resp_id int, response string")
    asked = spark.createDataFrame([(1, "Why?", "odd")], "prompt_id int, prompt string, use_case string")
    row = labels.judge_requests(batches, replies, asked, "RUBRIC").first()
    assert row.request == (
        "RUBRIC\n\nUSER-SELECTED USE CASE:\ntext-generation\n\nPROMPT:\nWhy?\n\n"
        "MODEL RESPONSES (2 total):\n\n[Response 1] model_id: a\none\n\n---\n\n"
        "[Response 2] model_id: b\n" + "two" * 5000)


def item(model, score):
    return {"model_id": model, "accuracy_score": score}


def test_merge_scores(spark):
    answers = {
        1: json.dumps([item("a", 80), item("b", 70)]),
        2: "```json\n" + json.dumps([item("a", 80)]) + "\n```",
        3: "sorry",
        4: json.dumps(item("a", 80)),
        5: json.dumps([item("a", 80), item("a", 60), item("b", 9)]),
        6: json.dumps([item("x", 80), item("y", 60)]),
        7: "[]",
        8: "```\n" + json.dumps([item("a", 1.5), item("b", 2)]) + "```",
    }
    members = spark.createDataFrame(
        [(b, m) for b in (*answers, 9) for m in ("a", "b")], "batch_id int, model_id string")
    texts = spark.createDataFrame(list(answers.items()), "batch_id int, judge_text string")
    got = {(r.batch_id, r.model_id): r.accuracy_score
           for r in labels.merge_scores(members, texts).collect()}
    expected = {1: (80, 70), 2: (80, 50), 3: (0, 0), 4: (50, 50), 5: (60, 0), 6: (0, 0),
                7: (50, 50), 8: (1.5, 2), 9: (0, 0)}
    assert got == {(b, m): s for b, pair in expected.items() for m, s in zip("ab", pair)}


def test_label_errors(spark):
    expected = spark.createDataFrame(
        [(c, str(i)) for c in range(1, 7) for i in (c * 10, c * 10 + 1)], "chunk int, prompt_id string")
    returned = spark.createDataFrame(
        [(1, 1, "10", "clear"), (1, 2, "11", " PARTIAL"),
         (2, 1, "20", "CLEAR"),
         (3, 1, "30", "odd"), (3, 2, "99", "CLEAR"),
         (4, 1, "99", "odd"), (4, 2, "40", "odd"),
         (5, 1, "50", "CLEAR"), (5, 2, "50", "CLEAR")],
        "chunk int, position int, prompt_id string, clarity string")
    got = {r.chunk: r.error for r in labels.label_errors(expected, returned).collect()}
    assert got == {
        1: None,
        2: "Expected 2 clarity labels, got 1",
        3: "Invalid clarity label returned: ODD",
        4: "Unexpected prompt_id returned: 99",
        5: "Missing clarity labels: 1",
        6: "Expected 2 clarity labels, got 0",
    }


def test_pending_and_user_labeller(spark):
    rows = spark.createDataFrame([(1, "a", "reasoning"), (2, "b", "reasoning"), (3, "a", "code-generation")],
                                 "prompt_id int, prompt string, use_case string")
    done = spark.createDataFrame([(" a ", "Reasoning")], "prompt string, use_case string")
    assert [r.prompt_id for r in labels.pending(rows, done).orderBy("prompt_id").collect()] == [2, 3]
    assert [r.prompt_id for r in labels.pending(rows, done, 1).collect()] == [2]

    def stub(batch):
        batch["clarity"] = batch["prompt"].str.upper()
        return batch[["prompt_id", "clarity"]]

    labelled = labels.label_with(rows.select("prompt_id", "prompt"), stub, "prompt_id int, clarity string")
    assert {(r.prompt_id, r.clarity) for r in labelled.collect()} == {(1, "A"), (2, "B"), (3, "A")}
    assert labels.attach_labels(rows, labelled).count() == 3


def body(**fields):
    return json.dumps(fields)


def test_response_formats(spark):
    rows = [
        ("meta", "q", body(generation="g", prompt_token_count=3, generation_token_count=4), "g", 3, 4),
        ("meta", "q", body(), "", 0, 0),
        ("nova", "q", body(output={"message": {"content": [{"text": "n"}]}},
                           usage={"inputTokens": 5, "outputTokens": 6}), "n", 5, 6),
        ("gemini", "q", body(text="v", usage_metadata={"prompt_token_count": 1}), "v", 1, 0),
        ("messages", "q", body(content=[{"text": "c"}], usage={"input_tokens": 0, "prompt_tokens": 7,
                                                               "output_tokens": 8}), "c", 7, 8),
        ("messages", "q", body(content=[{"text": ""}], choices=[{"message": {"content": "ch"}}],
                               usage={"total": 1}), "ch", 0, 0),
        ("messages", "12345678", body(choices=[{"message": {"content": "abcd", "reasoning_content": "efgh"}}]),
         "abcd", 2, 2),
        ("messages", "q", body(outputs=[{"text": "o"}], usage={}), "o", 1, 0),
        ("messages", "", "not json", "", 0, 0),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)],
                               "i int, fmt string, prompt string, raw_body string")
    got = responses.parse_responses(df).orderBy("i").collect()
    assert [(r.response, r.input_tokens, r.output_tokens) for r in got] == [r[3:] for r in rows]
    assert all(r.tokens == r.input_tokens + r.output_tokens for r in got)


def test_cost_and_defaults(spark):
    df = spark.createDataFrame(
        [("nova-lite", "nova", 1000, 500), ("new", "messages", 10**6, 0), ("new", "gemini", 1000, 1000)],
        "short_id string, fmt string, input_tokens bigint, output_tokens bigint")
    got = responses.with_cost(df, price_table(spark)).collect()
    assert sorted(r.cost for r in got) == [0.00018, 0.0005, 0.002]


def test_benchmark_rows_and_failures(spark):
    replies = spark.createDataFrame(
        [(1, "a", "P", "q", "text", 1.0, 2, 3), (1, "b", "P", "q", " ", 1.0, 2, 3), (1, "c", "P", "q", "t", 1.0, 2, 3)],
        "prompt_id int, model_id string, provider string, prompt string, response string, cost double, tokens bigint, latency_ms bigint")
    scores = spark.createDataFrame([(1, "a", 88.0)], "prompt_id int, model_id string, accuracy_score double")
    asked = spark.createDataFrame([(1, "low", "reasoning", "CLEAR")],
                                  "prompt_id int, prompt_complexity string, use_case string, clarity string")
    rows = responses.benchmark_rows(replies, scores, asked).collect()
    assert {(r.model_id, r.accuracy_score) for r in rows} == {("a", 88.0), ("c", 0.0)}
    _, failed = clean.split_responses(replies)
    assert [(r.model_id, r.cost, r.tokens, r.latency_ms) for r in failed.collect()] == [("b", 0.0, 0, 3)]


def test_restrict_models(spark):
    df = spark.createDataFrame([("nova-lite", "reasoning"), ("nova-lite", "code-generation")],
                               "model_id string, use_case string")
    kept = clean.restrict_models(df, allowed_models(spark)).collect()
    assert [(r.model_id, r.use_case) for r in kept] == [("nova-lite", "reasoning")]
    odd = spark.createDataFrame([("poetry",), ("reasoning",)], "use_case string")
    errors = [r.error for r in clean.require_known_use_case(odd).orderBy("use_case").collect()]
    assert errors[0].startswith("Unknown use_case 'poetry'.") and errors[1] is None


def test_scores_in_quotes_count(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b")], "batch_id int, model_id string")
    answer = '[{"model_id":"a","accuracy_score":"91"},{"model_id":"b","accuracy_score":7.5}]'
    answers = spark.createDataFrame([(1, answer)], "batch_id int, judge_text string")
    found = {r.model_id: r.accuracy_score for r in labels.merge_scores(members, answers).collect()}
    assert found == {"a": 91.0, "b": 7.5}


def test_scores_of_a_prompt_count_over_all_its_batches(spark):
    members = spark.createDataFrame(
        [("p", 1, "a"), ("p", 1, "b"), ("p", 2, "c"), ("q", 3, "a"), ("q", 3, "b"), ("q", 4, "d"), ("r", 5, "e"), ("r", 6, "f")],
        "prompt_id string, batch_id int, model_id string",
    )
    score = lambda **given: "[" + ",".join(f'{{"model_id":"{m}","accuracy_score":{s}}}' for m, s in given.items()) + "]"
    answers = [(1, score(a=9, c=33)), (2, score(x=8)), (3, score(a=7)), (4, "no json"), (5, "{}")]
    answers = spark.createDataFrame(answers, "batch_id int, judge_text string")
    found = {(r.prompt_id, r.model_id): r.accuracy_score for r in labels.merge_prompt_scores(members, answers).collect()}
    assert found == {
        ("p", "a"): 9, ("p", "b"): 0, ("p", "c"): 33, ("q", "a"): 7, ("q", "b"): 50, ("q", "d"): 0, ("r", "e"): 50, ("r", "f"): 0,
    }
    assert labels.merge_prompt_scores(members.where("false"), answers).count() == 0


def test_missing_ids_are_listed_in_order(spark):
    expected = spark.createDataFrame([(1, f"p{i}", 10 - i) for i in range(5)] + [(2, "z", 1)], "chunk int, prompt_id string, position int")
    returned = spark.createDataFrame([(1, "p3"), (1, "p3"), (2, "z"), (1, "z")], "chunk int, prompt_id string")
    found = [tuple(r) for r in labels.label_missing(expected, returned, most=2).collect()]
    assert found == [(1, 4, ["p4", "p2"], "Missing clarity labels for prompt_ids: p4, p2, ...")]
    whole = labels.label_missing(expected, returned).first()
    assert whole.error == "Missing clarity labels for prompt_ids: p4, p2, p1, p0"


def test_messages_of_bounded_size_join_to_the_whole_request(spark):
    rows = [("p", i, f"m{i % 3}", "abé"[: i % 4]) for i in range(3000)] + [("q", 5000, "m", "x" * 700), ("q", 5001, "m", None), ("r", 5002, "m", "y")]
    answers = spark.createDataFrame(rows, "prompt_id string, resp_id int, model_id string, response string").repartition(5)
    known = answers.where("response IS NOT NULL")
    asked = spark.createDataFrame([("p", "why?", "Reasoning"), ("q", "é" * 120, None)], "prompt_id string, prompt string, use_case string")
    batches = labels.token_batches(known)
    assert batches.where("prompt_id = 'p'").select("batch").distinct().count() == 1
    found = labels.judge_messages(batches, known, asked, "Rubric", most_chars=100).collect()
    joined = {}
    for r in sorted(found, key=lambda r: r.part):
        assert 0 < len(r.text) <= 100 and len(joined.get((r.prompt_id, r.batch), "")) == 100 * r.part
        joined[r.prompt_id, r.batch] = joined.get((r.prompt_id, r.batch), "") + r.text
    wanted = {(r.prompt_id, r.batch): r.request for r in labels.judge_requests(batches, known, asked, "Rubric").collect()}
    assert {k: v for k, v in joined.items() if k[0] != "r"} == wanted
    assert joined["r", 1].endswith("PROMPT:\n\n\nMODEL RESPONSES (1 total):\n\n[Response 1] model_id: m\ny")


def test_running_sums_over_hot_groups(spark):
    rng = random.Random(4)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 5}", i, rng.randrange(9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i int, n bigint").repartition(7)
    got = {r.i: r.before for r in running_sums(df, ["i"], ["g"], "n").collect()}
    seen = {}
    for g, i, n in rows:
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + n


def test_chunks_are_asked_for_once_over_two_runs(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = spark.range(100).selectExpr("id DIV 10 AS chunk", "id AS prompt_id", "'text' AS prompt")
    log = AnswerLog(spark, str(tmp_path / "log"), "prompt_id bigint, clarity string", chunks_per_wave=4)

    def labeller(chunk):
        number = int(chunk["chunk"].iloc[0])
        with open(asked / str(number), "a") as file:
            file.write("x")
        if number in (3, 7) and (asked / str(number)).stat().st_size == 1:
            raise TimeoutError("late")
        return chunk.assign(clarity=f"c{number}")

    log.run(rows, labeller)
    assert log.pending(rows).select("chunk").distinct().count() == 2
    assert {tuple(r) for r in log.failures().collect()} == {(3, "TimeoutError: late"), (7, "TimeoutError: late")}
    again = AnswerLog(spark, str(tmp_path / "log"), "prompt_id bigint, clarity string")
    again.run(rows, labeller)
    again.run(rows, labeller)
    assert {f.name: f.stat().st_size for f in asked.iterdir()} == {str(n): 2 if n in (3, 7) else 1 for n in range(10)}
    assert sorted((r.prompt_id, r.clarity) for r in again.answers().collect()) == [(i, f"c{i // 10}") for i in range(100)]


def test_second_run_outlives_the_files_that_its_own_waves_merge(spark, tmp_path):
    rows = spark.range(60).selectExpr("id DIV 2 AS chunk", "id AS prompt_id", "repeat('text', 200) AS prompt")
    log = AnswerLog(spark, str(tmp_path / "log"), "prompt_id bigint, clarity string", chunks_per_wave=3)
    log.store.least = 0  # deltas are merged, and their files removed, after nearly every wave

    def broken(chunk):
        if chunk["chunk"].iloc[0] % 3 == 0:
            raise ConnectionError("no answer")
        return chunk.assign(clarity="first")

    log.run(rows, broken)
    assert log.pending(rows).select("chunk").distinct().count() == 10
    log.run(rows, lambda chunk: chunk.assign(clarity="second"))
    got = sorted((r.prompt_id, r.clarity) for r in log.answers().collect())
    assert got == [(i, "second" if i // 2 % 3 == 0 else "first") for i in range(60)]
