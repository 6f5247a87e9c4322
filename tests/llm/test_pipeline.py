"""The pipeline against a plain version, and every query's columns over small tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from benchsieve.functions.durable import settle
from benchsieve.llm import op1_langid, op2_mixing, op7_toxicity, queries
from tests.llm.brute import near_components, words_of
from tests.llm.test_mixing_and_packing import check_places, expected_pieces

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op5_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_warc_archives": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_have_the_columns_of_their_contract(spark, name):
    result = __spark_entry__.queries()[name](spark, SF)
    assert result.columns == COLUMNS[name]
    table = "embeddings" if name.startswith("op3") else "pages" if name[:3] in ("op6", "op8") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    if table == "embeddings":
        wanted = 20 * rows.where("vec_id % 20 = 0").count()
    else:
        wanted = rows.count()
    if name.startswith("op10"):
        assert result.select("doc_id").distinct().count() == wanted
    else:
        assert result.count() == wanted


def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    language = queries.language_model(docs)
    clear = [r.doc_id for r in op1_langid.identify(docs, language).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.CLEAR_LANGUAGE]
    stage = docs.where(F.col("doc_id").isin(clear))
    model = queries.toxicity_model(stage, labels)
    clean = [r.doc_id for r in op7_toxicity.score(stage, model).collect() if r.score < queries.TOXIC_FROM]
    stage = stage.where(F.col("doc_id").isin(clean))
    rows = [(r.doc_id, r.text) for r in stage.collect()]
    kept = {k for k, (_, c) in near_components(rows, 80).items() if k == c}
    rows = stage.where(F.col("doc_id").isin(list(kept)))
    copies = Counter()
    for r in op2_mixing.mix(rows.select("doc_id", "text", "source")).collect():
        assert r["size"] == len(words_of(r.text))
        if r["size"] and r.taken:
            copies[r.doc_id] += int(np.floor(r.taken / r["size"] + 0.5))
    texts = {r.doc_id: r.text for r in rows.collect()}
    wanted = expected_pieces([(k, texts[k]) for k, n in copies.items() for _ in range(n)], 4096)
    found = corpus_pipeline.run(spark, SF).collect()
    got = Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in found)
    assert got == wanted
    check_places(found, lambda r: r.sequence_id, 4096)
    assert columns == docs.columns


def test_stages_take_an_empty_table_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("target", F.lit("x")).withColumn("kept", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs.where("false"), SF)
        assert result.columns == docs.columns and result.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0


def test_stages_take_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (6, "the of " * 30_000, None, "z", 1)], base.schema)
    docs = base.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF))
    assert docs.count() > 0


def test_one_row_of_each_group_is_kept_whatever_its_key(spark):
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    rows = [(2, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (None, d), (None, d), (None, None), (3, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    found = Counter(r.text for r in kept.collect())
    assert found == {a: 1, b: 1, c: 1, d: 1, None: 2}
    assert Counter(r.doc_id for r in kept.collect())[2] == 1


def test_band_links_of_documents_are_a_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = __spark_entry__.queries()["op9_near_documents"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in near_components(rows, 80).items()}
    assert len(found) == len(rows)
