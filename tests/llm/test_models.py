import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from benchsieve.llm import op1_langid, op7_toxicity, queries, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language(documents):
    return queries.language_model(documents)


@pytest.fixture(scope="module")
def characters(documents):
    return op7_toxicity.character_model(documents)


def test_held_out_languages_are_found(documents, language):
    found = op1_langid.identify(documents, language).join(documents.select("doc_id", "lang"), "doc_id")
    right = found.where(op1_langid.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] >= 0.98


def test_language_of_odd_rows(spark, language):
    rows = [(1, None, "x"), (1, "", "x"), (None, "12 34 !?", "x"), (2, "½ ² 3", "x"), (3, "the and of ing " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = op1_langid.identify(docs, language).collect()
    assert [r.lang_pred for r in found[:4]] == ["und"] * 4 and {r.score for r in found[:4]} == {0.0}
    assert found[4].lang_pred == "en" and 0 < found[4].score <= 1
    kept = op1_langid.keep_known(docs, language, 0.4)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert op1_langid.identify(docs.where("false"), language).count() == 0


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, label string")
    model = op1_langid.learn(none)
    assert model.langs == []
    assert [r.lang_pred for r in op1_langid.identify(none, model).collect()] == ["und"]


def test_unseen_words_fall_back_to_the_longest_known_grams():
    def table(n):
        keys, _ = op1_langid.gram_keys(["abcde"], n)
        order = np.argsort(keys)
        scores = np.tile(np.log(np.float32([0.9, 0.1])), (len(keys), 1))
        return op1_langid.Table(keys[order], scores)

    empty = op1_langid.Table(np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))
    model = op1_langid.LanguageModel(["x", "y"], empty, {n: table(n) for n in range(1, 6)})
    scores = model.word_scores(["abcdx", "zzzzz", "b"])
    assert scores[0] == pytest.approx(np.log([0.9, 0.1]), abs=1e-5)
    assert scores[2][0] > scores[2][1]
    assert (scores[1] == model.grams[1].scores[0]).all() or scores[1] == pytest.approx(np.log([0.9, 0.1]), abs=1e-5)


def test_disguised_words_are_restored(characters):
    restorer = op7_toxicity.Restorer(characters)
    for token, word in {"m0r0n": "moron", "stuuuuupid": "stupid", "p@thetic": "pathetic", "i.d.i.o.t": "idiot", "tr@sh!": "trash"}.items():
        assert restorer.restore(token) == [word]
    assert restorer.restore("plain,") == ["plain"] and restorer.restore("2024") == []
    assert restorer.spaced(list("scum")) == ["scum"]
    assert restorer.restore("") == []


def test_long_and_letterless_tokens_are_restored(characters):
    restorer = op7_toxicity.Restorer(characters)
    text = ["this", "is", "what", "the", "people", "said", "about", "their", "house"] * 4
    for joint in "_.-":
        for token, word in {"m0r0n": "moron", "i.d.i.o.t": "idiot", "p@thetic": "pathetic"}.items():
            long = joint.join([*text, token, *text])
            assert len(long) > 100 and word in " ".join(restorer.restore(long))
    long = "_".join([*text, "m0r0n"] * 1500)
    assert "".join(restorer.restore(long)).count("moron") == 1500 and not restorer.seen.keys() & {long}
    assert restorer.restore("7r@$4") != [] and restorer.restore("1-0") != []
    assert restorer.restore("2024") == restorer.restore("12.5%") == restorer.restore("--") == []


def test_a_search_that_puts_text_aside_finds_the_same(characters, monkeypatch):
    rng = np.random.default_rng(4)
    tokens = ["".join(rng.choice(list("abet10$@._-"), 90)) for _ in range(40)]
    found = [op7_toxicity.decode(op7_toxicity.lattice(t), characters) for t in tokens]
    monkeypatch.setattr(op7_toxicity, "HELD", 3)
    assert [op7_toxicity.decode(op7_toxicity.lattice(t), characters) for t in tokens] == found


def test_toxicity_of_words_in_signs_and_in_long_tokens(spark):
    _, docs = labelled(spark)
    model = op7_toxicity.learn(docs, op7_toxicity.character_model(docs))
    clean = ["cola", "dine", "gate", "bum"] * 20
    texts = ["_".join([*clean, "l0ser", *clean]), "_".join(clean), "1053", "l0se", "104 15 1 100 10.14"]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def found():
        return [r.score >= 0.3 for r in op7_toxicity.score(odd, model).orderBy("doc_id").collect()]

    # A beginning counts for words with letters, whole words for all.
    model.odds["3los"] = model.odds["wloser"]
    assert found() == [True, False, False, True, False]
    model.odds["wlose"] = model.odds["wloser"]
    assert found() == [True, False, True, True, False]
    restorer = op7_toxicity.Restorer(model.characters)
    assert op7_toxicity.token_features("1053", restorer) == ["wlose"]
    assert op7_toxicity.token_features("l0se", restorer) == ["wlose", "3los"]


def test_trigrams_come_from_words_of_all_scripts_and_marks():
    def grams(*tokens):
        packed, n = op7_toxicity.trigram_counts(list(tokens), np.ones(len(tokens), np.int64))
        bits, least = op7_toxicity.POINT, (1 << op7_toxicity.POINT) - 1
        return {"".join(chr(p >> at & least) for at in (2 * bits, bits, 0)): c for p, c in zip(packed.tolist(), n.tolist(), strict=True)}

    assert grams("ab") == {"  a": 1, " ab": 1, "ab ": 1}
    assert grams("ab,", '"ab"', "ab!", "(ab)", "ab-ab", "ab's") == {"  a": 7, " ab": 7, "ab ": 7, "  s": 1, " s ": 1}
    assert grams("дурак.") == {"  д": 1, " ду": 1, "дур": 1, "ура": 1, "рак": 1, "ак ": 1}
    assert grams("𐐨字") == {"  𐐨": 1, " 𐐨字": 1, "𐐨字 ": 1} and grams("किन") == grams("कन") != {}
    assert grams("m0r0n", "i.d.i.o.t", "12", "--") == {}


def test_disguises_of_other_scripts_are_restored(spark):
    docs = spark.createDataFrame([(1, "ты дурак, а он дурак. " * 20)], "doc_id long, text string")
    restorer = op7_toxicity.Restorer(op7_toxicity.character_model(docs))
    assert restorer.restore("д.у.р.а.к") == ["дурак"] and restorer.restore("ду_рак") == ["дурак"]


def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        body = [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfg"), 40), rng.choice(["ola", "ine", "ate", "um"], 40), strict=True)]
        bad = i % 5 == 0
        if bad:
            body[int(rng.integers(40))] = "loser" if i % 2 else "idiot"
        rows.append((i, " ".join(body), int(bad)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity_learns_and_sees_through_disguises(spark):
    rows, docs = labelled(spark)
    characters = op7_toxicity.character_model(docs)
    model = op7_toxicity.learn(docs.where("doc_id % 4 != 2"), characters)
    found = {r.doc_id: r.score for r in op7_toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.3) == bool(bad) for i, _, bad in rows)
    texts = ["you are a l0ser", "what an iiiidiot", "such an i d i o t", "LOSER!", "bola cine", None, "", "cine " * 60_000]
    odd = spark.createDataFrame([(1, t, 2) for t in texts], "doc_id int, text string, score int")
    scores = [r.score for r in op7_toxicity.score(odd, model).collect()]
    assert [s >= 0.3 for s in scores] == [True] * 4 + [False] * 4
    assert op7_toxicity.keep_clean(odd, model, 0.3).count() == 4
    assert op7_toxicity.score(odd.where("false"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, label int")
    model = op7_toxicity.learn(docs, op7_toxicity.character_model(docs))
    assert [r.score for r in op7_toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_runs_of_letters():
    values = pa.array(["aab", "aaa", "b", "ba", "", "éé", "xaaay"])
    assert op7_toxicity.has_run(values, 2).tolist() == [True, True, False, False, False, False, True]
    assert op7_toxicity.has_run(values, 3).tolist() == [False, True, False, False, False, False, True]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c" * 10])], ["text"])
    parts = list(words.slices(batch, most=20))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
