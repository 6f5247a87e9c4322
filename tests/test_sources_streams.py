import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from benchsieve.operators import aggregate, classify
from benchsieve.sources import readers, schemas, writers
from benchsieve.streaming import jobs


def test_benchmark_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "bench.csv"
    path.write_text(
        'id,provider,model_id,use_case,response,accuracy_score,cost\n'
        '1,P,m,reasoning,"line one\nline ""two"", end",90,0.1\n2,P,n,reasoning,,80,\n'
    )
    rows = readers.read_benchmark_csv(spark, str(path)).orderBy("id").collect()
    assert rows[0].response == 'line one\nline "two", end' and rows[0].clarity is None
    assert (rows[1].response, rows[1].cost, rows[1].accuracy_score) == (None, None, "80")
    found = readers.read_phases(spark, [str(path), str(tmp_path / "absent.csv")])
    assert found.count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_phases(spark, [str(tmp_path / "absent.csv")])


def test_prompt_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('prompt,clarity\n" one ",clear\n,CLEAR\ntwo, partial\n')
    (tmp_path / "b.csv").write_text("prompt,clarity\nthree,odd\n")
    (tmp_path / "c.csv").write_text('prompt,clarity\n"  ",odd\n')
    rows = readers.read_prompt_files(spark, str(tmp_path))
    report = {r.file_name: (r.prompt_count, r.status) for r in readers.prompt_file_report(rows).collect()}
    assert report == {"a.csv": (2, "accepted"), "b.csv": (1, "rejected"), "c.csv": (0, "empty")}
    kept = readers.ingest_prompts(rows, "reasoning", "mid", strict=False).collect()
    assert sorted((r.prompt, r.clarity, r.row_pos) for r in kept) == [("one", "CLEAR", 1), ("two", "PARTIAL", 3)]
    ids = readers.ingest_clarity_input(rows).where("file_name = 'a.csv'").collect()
    assert sorted((r.prompt_id, r.prompt) for r in ids) == [("1", "one"), ("3", "two")]
    with pytest.raises(readers.InputRejected, match="ODD"):
        readers.ingest_prompts(rows, "reasoning", "mid")
    with pytest.raises(readers.InputRejected, match="use_case"):
        readers.ingest_prompts(rows, "poetry", "mid")
    with pytest.raises(readers.InputRejected, match="No valid"):
        readers.ingest_prompts(rows.where("file_name = 'c.csv'"), "reasoning", "mid")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text("prompt,accuracy\nx,1\n")
    with pytest.raises(readers.InputRejected, match="clarity"):
        readers.read_prompt_files(spark, str(tmp_path / "sub"))


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("reasoning", "low", "m", 1.0), ("reasoning", "mid", "n", 2.0)],
                                 "use_case string, prompt_complexity string, model_id string, cost double")
    for _ in range(2):
        writers.append_benchmark(rows, str(tmp_path / "bench"))
    table = spark.read.parquet(str(tmp_path / "bench"))
    scan = readers.scan_benchmark(table, complexity="low")
    assert scan.count() == 2
    assert "PartitionFilters: [isnotnull(prompt_complexity" in scan._jdf.queryExecution().toString()

    chunked = spark.createDataFrame([(1, "a\nb", "CLEAR"), (2, 'q"', "PARTIAL")], "chunk int, prompt string, clarity string")
    writers.write_chunks(chunked, str(tmp_path / "few"))
    assert {(r.chunk, r.prompt) for r in readers.read_chunks(spark, str(tmp_path / "few")).collect()} == {(1, "a\nb"), (2, 'q"')}
    writers.write_chunks(chunked, str(tmp_path / "chunks"), folder_per_chunk=True)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "chunks"))
    assert {(r.chunk, r.prompt) for r in back.collect()} == {(1, "a\nb"), (2, 'q"')}

    profile_rows = spark.createDataFrame([("P", "m", "low", 90.0, 1.0, 2.0, 3.0)],
        "provider string, model_id string, prompt_complexity string, accuracy_score double, cost double, latency_ms double, tokens double")
    documents = aggregate.nested_profiles(profile_rows)
    writers.write_profiles(documents, str(tmp_path / "profiles"))
    assert readers.read_profiles(spark, str(tmp_path / "profiles")).collect() == documents.collect()

    labelled = spark.createDataFrame([("p", "reasoning", "low", "CLEAR", "mid", "short")],
        "prompt string, use_case string, prompt_complexity string, clarity string, old_prompt_complexity string, complexity_reason string")
    writers.append_relabelled(labelled, str(tmp_path / "labels"), "labeller:1")
    assert spark.read.parquet(str(tmp_path / "labels")).first().label_source == "labeller:1"
    writers.append_prompt_logs(labelled, str(tmp_path / "logs"))
    assert spark.read.parquet(str(tmp_path / "logs")).columns == ["prompt", "use_case", "clarity"]
    assert readers.model_catalogue(spark).groupBy("source").count().count() == 2


START = datetime(2024, 1, 1)


def event(n, job, kind, **fields):
    return {"event_id": n, "ts": (START + timedelta(minutes=n)).isoformat(), "job_id": job, "type": kind, **fields}


EVENTS = [
    event(1, "a", "progress", prompt_index=1, total=4),
    event(2, "a", "model_failed", prompt_index=1, total=4, model_id="m"),
    event(3, "b", "file_started", file_index=1, processed_prompts=0, total=2),
    event(4, "a", "progress", prompt_index=3, total=4),
    event(5, "b", "file_done", file_index=1, processed_prompts=2, total=2),
    event(6, "b", "done", prompt_index=2, total=2),
    event(7, "c", "chunk_ready", chunk_index=1, processed_prompts=5),
    event(8, "c", "chunk_forwarding", chunk_index=1),
    event(9, "c", "error", message="x"),
    event(10, "c", "progress", prompt_index=9, total=9),
]


@pytest.fixture()
def event_files(tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for i in range(0, len(EVENTS), 3):
        text = "\n".join(json.dumps(e) for e in EVENTS[i : i + 3])
        (folder / f"{i}.json").write_text(text)
    return str(folder)


@pytest.mark.parametrize(
    "roll_up, keys",
    [
        (jobs.job_progress, ["job_id"]),
        (jobs.job_status, ["job_id"]),
        (jobs.job_starts, ["job_id"]),
        (jobs.file_lifecycle, ["job_id", "file_index"]),
        (jobs.chunk_lifecycle, ["job_id", "chunk_index"]),
    ],
)
def test_stream_equals_batch(spark, event_files, tmp_path, roll_up, keys):
    table = spark.read.schema(schemas.JOB_EVENT).json(event_files)
    wanted = {tuple(r) for r in roll_up(table).collect()}
    rolled = roll_up(jobs.read_events(spark, event_files, files_per_batch=1))
    jobs.write_updates(rolled, str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    latest = jobs.latest_rows(spark, str(tmp_path / "rows"), rolled.schema, keys)
    assert {tuple(r) for r in latest.collect()} == wanted


def test_event_roll_ups(spark, event_files):
    table = spark.read.schema(schemas.JOB_EVENT).json(event_files)
    progress = {r.job_id: (r.current, r.result_count, r.failed_count, r.percent) for r in jobs.job_progress(table).collect()}
    assert progress == {"a": (3, 2, 1, 75), "b": (2, 0, 0, 100), "c": (9, 1, 0, 100)}
    status = {r.job_id: r.status for r in jobs.job_status(table).collect()}
    assert status == {"a": "running", "b": "done", "c": "error"}
    assert {r.event_id for r in jobs.until_terminal(table).collect()} == set(range(1, 10))
    assert [r.model_id for r in jobs.failures(table).collect()] == ["m"]


def test_lifecycles_keep_what_events_tell(spark):
    told = [
        {"type": "started", "total": 9, "total_chunks": 2, "auto_forward": True, "use_case": "code"},
        {"type": "file_started", "file_index": 1, "file_name": "a.csv", "total_files": 2, "total": 9},
        {"type": "file_delay", "file_index": 1, "next_file_index": 2, "delay_ms": 500, "total": 9},
        {"type": "chunk_ready", "chunk_index": 1, "file_name": "c.csv", "chunk_size": 5, "forward_status": "pending"},
        {"type": "chunk_forwarding", "chunk_index": 1, "file_name": "c.csv"},
        {"type": "chunk_forward_failed", "chunk_index": 2, "forward_status": "failed", "message": "no reply"},
        {"type": "started", "total": 8},
    ]
    fields = schemas.JOB_EVENT.fieldNames()
    rows = [{"job_id": "a", "event_id": i, "ts": datetime(2025, 1, 1)} | e for i, e in enumerate(told)]
    events = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schemas.JOB_EVENT)
    assert [tuple(r) for r in jobs.job_starts(events).collect()] == [("a", 9, 2, True, None, "code")]
    assert [tuple(r) for r in jobs.file_lifecycle(events).collect()] == [("a", 1, "waiting", None, 9, 500, 2, "a.csv", 2)]
    chunks = {r.chunk_index: tuple(r)[2:] for r in jobs.chunk_lifecycle(events).collect()}
    assert chunks == {
        1: ("forwarding", 1, "c.csv", 5, "pending", None, None),
        2: ("failed", 0, None, None, "failed", None, "no reply"),
    }


def test_repeated_events_are_dropped(spark, event_files, tmp_path):
    with open(f"{event_files}/again.json", "w") as file:
        file.write("\n".join(json.dumps(e) for e in EVENTS[:4]))
    schema = schemas.JOB_EVENT
    stream = jobs.read_events(spark, event_files).withColumn("ts", F.col("ts").cast("timestamp"))
    unique = jobs.drop_repeats(stream)
    jobs.write_updates(unique, str(tmp_path / "rows"), str(tmp_path / "checkpoint"), "append")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == len(EVENTS)
    assert len(schema) == len(unique.schema)


def test_finished_chunks_become_benchmark_rows(spark, tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "1.json").write_text('{"prompt": "a", "clarity": "clear"}')
    (folder / "2.json").write_text('{"prompt": " ", "clarity": "clear"}\n{"prompt": "b", "clarity": "odd"}')
    stream = spark.readStream.schema("prompt string, clarity string").json(str(folder))
    replies = spark.createDataFrame([("a", "m", 80.0), ("b", "m", 70.0)], "prompt string, model_id string, accuracy_score double")

    def to_benchmark(batch):
        prompts = readers.check_prompt_rows(batch).where("is_valid").drop("is_valid")
        return prompts.join(replies, "prompt")

    jobs.forward_chunks(stream, to_benchmark, str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert [(r.prompt, r.clarity, r.accuracy_score) for r in rows] == [("a", "CLEAR", 80.0)]


def training(spark):
    texts = {"low": "what is the capital city", "mid": "explain how caches work", "high": "design a distributed system"}
    rows = [(i * 3 + j, f"{text} number {i % 4}", label) for i in range(8) for j, (label, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "doc_id int, text string, label string")


def test_term_weights(spark):
    docs = spark.createDataFrame([(1, "A b a"), (2, "a É"), (3, "e c")], "doc_id int, text string")
    terms = classify.document_terms(docs)
    got = {(r.doc_id, r.term): r.tf for r in terms.collect()}
    assert got[(1, "a")] == 2 and got[(1, "a b")] == 1 and got[(2, "a e")] == 1
    vocab = classify.vocabulary(terms, 3)
    assert [r.term for r in vocab.orderBy("index").collect()] == ["a", "e"]
    weights = {(r.doc_id, r.term): r.weight for r in classify.term_weights(terms, vocab).collect()}
    assert weights[(1, "a")] == 1.0 and weights[(2, "a")] == pytest.approx(0.5**0.5)


def test_classifier(spark, tmp_path):
    rows = training(spark)
    model = classify.train(rows)
    model.save(str(tmp_path / "model"))
    loaded = classify.TextClassifier.load(spark, str(tmp_path / "model"))
    unseen = spark.createDataFrame([(1, "design the distributed cache"), (2, "zzz")], "doc_id int, text string")
    first, second = (m.score(unseen).orderBy("doc_id").collect() for m in (model, loaded))
    assert [r.probabilities for r in first] == [r.probabilities for r in second]
    assert first[0].predicted == "high" and set(first[0].probabilities) == {"low", "mid", "high"}
    assert sum(first[1].probabilities.values()) == pytest.approx(1.0, abs=1e-3)
    scored = model.score(rows)
    report = classify.overall_report(scored, "label", "predicted").first()
    assert (report.row_count, report.accuracy, report.weighted_f1) == (24, 1.0, 1.0)


def test_folds_and_cross_validation(spark):
    rows = training(spark).where("label != 'low' or doc_id < 9")
    folds = classify.stratified_folds(rows, "label", "doc_id", 3).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in folds} == {("low", 1), ("mid", 3), ("mid", 2), ("high", 3), ("high", 2)}
    split = classify.stratified_split(rows, "label", "doc_id", 0.25).where("is_validation")
    assert {(r.label, r["count"]) for r in split.groupBy("label").count().collect()} == {("low", 1), ("mid", 2), ("high", 2)}
    # All classes need two training documents per term, so the full rows are used here.
    rows = training(spark)
    results = classify.cross_validate(rows, max_folds=2)
    assert results.count() == 2 and results.agg(F.min("accuracy")).first()[0] > 0.9
    report = classify.training_report(rows, results).collect()
    assert len(report) == 3 and report[0].cv_folds == 2
    assert classify.cross_validate(rows.where("doc_id = 0 or label = 'mid'")).count() == 0


def test_folds_over_few_terms_match_a_classifier_for_each(spark):
    rows = training(spark)
    found = {r.fold: (r.row_count, r.accuracy) for r in classify.cross_validate(rows, max_folds=3, max_features=12).collect()}
    placed = classify.stratified_folds(rows, "label", "doc_id", 3).cache()
    for fold in range(3):
        model = classify.train(placed.where(F.col("fold") != fold), max_features=12)
        report = classify.overall_report(model.score(placed.where(F.col("fold") == fold)), "label", "predicted").first()
        assert found[fold] == pytest.approx((report.row_count, report.accuracy))


def test_folds_over_few_terms_take_repeated_keys(spark):
    rows = training(spark)
    twice = rows.unionByName(rows).unionByName(rows.withColumn("doc_id", F.lit(None).cast("int")))
    results = classify.cross_validate(twice, max_folds=2, max_features=40).collect()
    assert sum(r.row_count for r in results) == 3 * rows.count() and min(r.accuracy for r in results) > 0.9


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prompt,clarity\nfirst,clear\n")
    (tmp_path / "b.csv").write_text('clarity,extra,prompt\nUNCLEAR,x,"second\nline"\n')
    both = readers.read_prompt_files(spark, str(tmp_path))
    assert sorted((r.file_name, r.row_pos, r.prompt, r.clarity) for r in both.collect()) == [
        ("a.csv", 1, "first", "clear"), ("b.csv", 1, "second\nline", "UNCLEAR")]
    (tmp_path / "c.csv").write_text("prompt\nthird\n")
    with pytest.raises(readers.InputRejected, match="'clarity' column"):
        readers.read_prompt_files(spark, str(tmp_path))
    assert readers.lacking_columns(spark, str(tmp_path)) == [("c.csv", "clarity")]
    assert readers.read_prompt_files(spark, str(tmp_path), skip_rejected=True).count() == 2

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.csv").write_text("id,model_id,cost\n1,m,0.7\n")
    (tmp_path / "d" / "two.csv").write_text("model_id,cost,id\nn,2,0.5\n")
    rows = readers.read_benchmark_csv(spark, str(tmp_path / "d")).select("id", "model_id", "cost")
    assert sorted(map(tuple, rows.collect())) == [("0.5", "n", "2"), ("1", "m", "0.7")]


def test_scans_of_a_stored_benchmark_skip_folders_and_row_groups(spark, tmp_path):
    rows = spark.range(6000).selectExpr(
        "id AS src_id", "element_at(array('reasoning', 'code-generation', '1'), int(id % 3 + 1)) AS use_case",
        "element_at(array('low', 'mid'), int(id % 2 + 1)) AS prompt_complexity",
        "element_at(array('CLEAR', 'PARTIAL', 'UNCLEAR'), int(id % 5 % 3 + 1)) AS clarity", "concat('m', id % 26) AS model_id",
    )
    path = str(tmp_path / "bench")
    writers.append_benchmark(rows, path)
    writers.append_benchmark(rows.where("src_id < 60"), path)
    table = readers.read_benchmark_table(spark, path)
    found = readers.scan_benchmark(table, "reasoning", "mid", "CLEAR")
    wanted = rows.where("use_case = 'reasoning' AND prompt_complexity = 'mid' AND clarity = 'CLEAR'")
    assert found.count() == wanted.count() + wanted.where("src_id < 60").count()
    assert {r.use_case for r in table.select("use_case").distinct().collect()} == {"reasoning", "code-generation", "1"}
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(use_case" in text and "EqualTo(clarity,CLEAR)" in text.replace("`", "")
    files = {r.f for r in found.selectExpr("input_file_name() AS f").collect()}
    assert 0 < len(files) < len({r.f for r in table.selectExpr("input_file_name() AS f").collect()}) / 2
    for file in files:
        held = [r.clarity for r in spark.read.parquet(file).select("clarity").collect()]
        assert held == sorted(held)


def test_tables_of_a_classifier_score_as_the_model(spark, tmp_path):
    rows = training(spark)
    model = classify.train(rows)
    model.as_tables().save(str(tmp_path / "tables"))
    tables = classify.TermModel.load(spark, str(tmp_path / "tables"))
    unseen = spark.createDataFrame(
        [(100, "design the distributed cache", "x"), (101, "zzz", "x"), (102, None, "x"), (103, "", "x"), (104, "capital city number", "x")],
        "doc_id int, text string, label string",
    )
    both = rows.unionByName(unseen)
    wanted = {r.doc_id: (r.predicted, r.confidence) for r in model.score(both).collect()}
    found = {r.doc_id: (r.predicted, r.confidence) for r in tables.score(both).collect()}
    assert found.keys() == wanted.keys()
    for key, (label, confidence) in wanted.items():
        assert found[key][1] == pytest.approx(confidence)
        assert found[key][0] == label or key in (101, 102, 103)
    assert tables.score(both.where("false")).count() == 0


def test_fold_vocabularies_are_those_of_the_other_folds(spark):
    placed = classify.stratified_folds(training(spark), "label", "doc_id", 3)
    terms = classify.document_terms(placed, "doc_id", "text", ("fold",))
    sizes = placed.groupBy("fold").agg(F.count(F.lit(1)).alias("row_count"))
    found = classify.fold_vocabularies(terms, sizes)
    columns = ("term", "doc_freq", "term_freq", "index", "idf")
    for fold in range(3):
        others = placed.where(F.col("fold") != fold)
        wanted = classify.vocabulary(classify.document_terms(others), others.count())
        got = found.where(F.col("fold") == fold)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b a B", "k"), (2, None, "k"), (3, " ", "k"), (4, "x", "k")], "doc_id int, text string, term string")
    terms = classify.document_terms(docs, "doc_id", "text")
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.term): r.tf for r in terms.collect()}
    assert got == {(1, "a"): 2, (1, "b"): 3, (1, "b a"): 2, (1, "a b"): 2, (4, "x"): 1}


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(2000):
        header = "prompt,clarity" if i % 2 else "clarity,note,prompt"
        row = f'"p{i}\nx",clear' if i % 2 else f"partial,n,p{i}"
        (folder / f"{i:04}.csv").write_text(f"{header}\n{row}\n")
    (folder / "odd.csv").write_text('"clarity","pro""mpt"\n')
    (folder / "two.csv").write_text('"two\nlines",prompt,clarity\nv,last,clear\n')
    (folder / "none.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "")
    groups = readers.files_by_header(spark, str(folder))
    jobs_used = len(sc.statusTracker().getJobIdsForGroup("headers"))
    sc.setJobGroup("", "")
    assert jobs_used < 30
    assert {h: len(f) for h, f in groups.items()} == {
        ("prompt", "clarity"): 1000, ("clarity", "note", "prompt"): 1000, ("clarity", 'pro"mpt'): 1,
        ("two\nlines", "prompt", "clarity"): 1,
    }
    rows = readers.read_prompt_files(spark, str(folder), skip_rejected=True)
    found = {(r.file_name, r.prompt, r.clarity) for r in rows.select("file_name", "prompt", "clarity").collect()}
    assert len(found) == 2001 and ("0001.csv", "p1\nx", "clear") in found and ("two.csv", "last", "clear") in found


def plain_terms(rows):
    found = {}
    for key, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            found[key, term] = found.get((key, term), 0) + 1
    return found


def test_terms_are_counted_in_parts_without_interpreted_arrays(spark, monkeypatch):
    monkeypatch.setattr(classify, "WORDS_AT_ONCE", 7)
    rows = [(i, "a b a b a" * (i % 5) + f" x{i % 3}") for i in range(50)] + [(50, None), (51, ""), (52, " - "), (53, "one"), (54, "y z " * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    terms = classify.document_terms(docs)
    assert {(r.doc_id, r.term): r.tf for r in terms.collect()} == plain_terms(rows)
    assert terms.where("false").count() == classify.document_terms(docs.where("doc_id > 99")).count() == 0
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "zip_with" not in plan


def test_linear_scores_move_each_term_once(spark):
    docs = spark.createDataFrame([(i, "alpha beta " + ("gamma" if i % 2 else "delta eps")) for i in range(20)], "doc_id bigint, text string")
    vocab = classify.vocabulary(classify.document_terms(docs), 20, max_share=1.0)
    weights = vocab.select("term", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("class"), F.lit(0.5).alias("weight"))
    classes = spark.createDataFrame([("a", 0.1), ("b", 0.0)], "class string, intercept double")
    model = classify.TermModel(vocab, weights.where("class = 'a' or term <> 'gamma'"), classes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scored = model.score(docs)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert {r.predicted for r in scored.collect()} == {"a"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Terms are read once: before, their weights, their lengths and their classes were three joins.
    assert plan.count("MapInArrow") == 1


def plain_fit(features, classes, penalty):
    """Newton's method on the dense problem: (coefficients, intercepts) of weighted classes."""
    import numpy as np

    x, y = np.array(features), np.array(classes)
    names = sorted(set(classes))
    counts = [(y == n).sum() for n in names]
    shares = np.array([[1 / (len(names) * c) if v == n else 0 for n, c in zip(names, counts)] for v in y])
    x1 = np.hstack([x, np.ones((len(x), 1))])
    d, k = x1.shape[1], len(names)
    theta, keep = np.zeros((d, k)), np.append(np.full(d - 1, penalty), 1e-12)
    for _ in range(30):
        p = np.exp(x1 @ theta)
        p /= p.sum(1, keepdims=True)
        weight = shares.sum(1)
        g = x1.T @ (weight[:, None] * p - shares) + keep[:, None] * theta
        h = np.zeros((d * k, d * k))
        for i in range(len(x1)):
            h += weight[i] * np.kron(np.outer(x1[i], x1[i]), np.diag(p[i]) - np.outer(p[i], p[i]))
        theta -= np.linalg.solve(h + np.kron(np.diag(keep), np.eye(k)), g.ravel()).reshape(d, k)
    return theta[:-1], theta[-1] - theta[-1].mean()


def test_coefficients_over_many_blocks_are_those_of_the_dense_problem(spark, monkeypatch):
    import numpy as np

    from benchsieve.operators import regression

    monkeypatch.setattr(regression, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(regression, "BUCKET_ENTRIES", 15)
    draw = np.random.default_rng(5)
    names = ["a", "b", "c"]
    held = [(i, names[i % 3], " ".join(f"w{draw.integers(0, 4) + 2 * (i % 3)}" for _ in range(draw.integers(1, 9)))) for i in range(60)]
    held.append((60, "a", "neverseen"))
    rows = spark.createDataFrame(held, "doc_id long, label string, text string")
    model = classify.train(rows, max_iterations=200)
    vocab = model.tables.vocab.orderBy("index").collect()
    weights = classify.term_weights(classify.document_terms(rows), model.tables.vocab)
    x = np.zeros((61, len(vocab)))
    for r in weights.collect():
        x[r.doc_id, r["index"]] = r.weight
    wanted, intercepts = plain_fit(x, [r[1] for r in held], 1 / (classify.INVERSE_REGULARISATION * 61))
    at = {r.term: r["index"] for r in vocab}
    found = np.zeros(wanted.shape)
    for r in model.tables.coefficients.collect():
        found[at[r.term], names.index(r["class"])] = r.weight
    assert np.abs(found - wanted).max() < 0.02 * np.abs(wanted).max()
    assert [r.intercept for r in model.tables.classes.orderBy("class").collect()] == pytest.approx(list(intercepts), abs=0.05)


def test_no_matrix_of_all_terms_is_on_the_driver(spark, monkeypatch):
    # Before, pyspark.ml held the coefficients and the vectors of its steps there.
    def refused(*args, **kwargs):
        raise AssertionError("all terms on the driver")

    monkeypatch.setattr(classify, "LogisticRegression", refused)
    assert classify.train(training(spark)).tables.classes.count() == 3
    again = training(spark).unionByName(spark.createDataFrame([(0, "design a cache", "low"), (None, "design a system", "high")], "doc_id int, text string, label string"))
    scored = classify.train(again).score(again)
    assert scored.count() == 26 and scored.where("predicted is null").count() == 0


def test_vocabularies_are_not_broadcast(spark):
    # Before, a compressed vocabulary below the threshold was built as a broadcast on the driver.
    rows = training(spark)
    vocab = classify.settle(classify.vocabulary(classify.document_terms(rows), 24))
    weights = classify.term_weights(classify.document_terms(rows), vocab)
    coefficients = vocab.select("term", F.lit("a").alias("class"), F.lit(0.5).alias("weight"))
    classes = spark.createDataFrame([("a", 0.1)], "class string, intercept double")
    scored = classify.TermModel(vocab, coefficients, classes).score_terms(classify.document_terms(rows), rows)
    for found in (weights, scored):
        assert "BroadcastHashJoin [term" not in found._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 24
