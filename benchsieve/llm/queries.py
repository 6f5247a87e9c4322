"""The queries of this package over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.llm import (
    op1_langid,
    op2_mixing,
    op3_neighbours,
    op4_token_shards,
    op5_near_dedup,
    op6_url_filter,
    op7_toxicity,
    op8_warc,
    op9_fingerprints,
    op10_packing,
    op11_variants,
    op12_merkle,
    op13_lm,
    sql,
    words,
)

TOXIC_FROM = 0.3
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def language_model(docs: DataFrame) -> op1_langid.LanguageModel:
    """Learned from the languages of documents outside the held-out fold."""
    labelled = docs.where(~op1_langid.held_out())
    return op1_langid.learn(labelled.select("doc_id", "text", F.col("lang").alias("label")))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> op7_toxicity.ToxicityModel:
    """Characters of all documents; labels of documents outside the held-out fold."""
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    toxic = toxic.where(F.col("label").isNotNull() & ~op1_langid.held_out())
    labelled = docs.select("doc_id", "text").join(toxic, "doc_id")
    return op7_toxicity.learn(labelled, op7_toxicity.character_model(docs))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op1_langid.identify(docs, language_model(docs))
    return found.select("doc_id", op1_langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = op2_mixing.mix(docs, weights=(3, 1, 2), total_share=1.5, most_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op3_neighbours.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op4_token_shards_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op4_token_shards.read_shards(op4_token_shards.write_shards(docs, tokenizer_path()))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return op6_url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_toxicity_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return op7_toxicity.score(docs, model).select(
        "doc_id",
        op1_langid.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = op8_warc.archive_pages(table(spark, sf_dir, "pages"))
    return op8_warc.read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints.near_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_variants.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in op12_merkle.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaf, claimed = op12_merkle.leaf_digest(fields), op12_merkle.leaf_digest([*fields[:-1], text])
    found = op12_merkle.manifest(docs, leaf, claimed)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        op12_merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        op12_merkle.fold(F.col("path"), F.col("claimed")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return op13_lm.score_texts(table(spark, sf_dir, "documents"), held, path, public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_source_mixing": op2_source_mixing,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_token_shards": op4_token_shards_,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_url_rules": op6_url_rules,
        "op7_toxicity": op7_toxicity_,
        "op8_warc_archives": op8_warc_archives,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op9_near_documents": op9_near_documents,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_lm_scores": op13_lm_scores,
        "pipeline": pipeline,
    }


def _rules_sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    upper, lower = op6_url_filter.UPPER, op6_url_filter.LOWER
    return f"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rows}),
    parsed AS (
      SELECT row_number() OVER () AS n, page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}')
               AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    ranked AS (
      SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY n
               ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
      FROM parsed p LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM ranked WHERE place = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_rules": _rules_sql(),
        "op8_warc_archives": f"""
    WITH sized AS (
      SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes
      FROM pages),
    first AS (
      SELECT *, CASE WHEN payload_bytes >= {op8_warc.REVISIT_BYTES}
                     THEN min(page_id) OVER (PARTITION BY html) END AS response
      FROM sized)
    SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL
                THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
    FROM first""",
        "op11_spelling_variants": sql.variants_sql(),
        "op12_merkle_manifest": sql.manifest_sql(),
    }
