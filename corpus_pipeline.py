"""A training corpus from documents in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes what a stage returns as Parquet in the shared folder and reads it for the next. All but
the last return the columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import op1_langid, op2_mixing, op5_near_dedup, op7_toxicity, op10_packing, words
from benchsieve.llm.queries import TOXIC_FROM, language_model, table, tokenizer_path, toxicity_model

#: Share of belief that a document's likeliest language needs.
CLEAR_LANGUAGE = 0.4
NEAR = op5_near_dedup.NearDedup(percent=80, rows=7, bands=48)


def keep_clear_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; those without letters or with a mixture go."""
    words.bounded_batches(spark)
    return op1_langid.keep_known(docs, language_model(docs), CLEAR_LANGUAGE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned on them and their labels, does not reject."""
    words.bounded_batches(spark)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return op7_toxicity.keep_clean(docs, model, TOXIC_FROM)


def with_row_keys(docs: DataFrame) -> DataFrame:
    """(key, row) of every row: ``doc_id``, or a key above all of them.

    Rows without ``doc_id`` and all but one row of a repeated one get new keys.
    """
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    again = settle(counts.where((F.col("n") > 1) & F.col("key").isNotNull()).select("key"))
    odd = rows.where(F.col("key").isNull()).unionByName(rows.join(again, "key", "left_semi"))
    odd = settle(odd.withColumn("n", F.monotonically_increasing_id()))
    most = rows.agg(F.max("key")).first()[0] or 0
    first = odd.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("own")).agg(F.min("n").alias("n"))
    new = odd.join(first, "n", "left").select(
        F.coalesce("own", F.lit(most) + 1 + F.col("n")).alias("key"), "row"
    )
    return rows.where(F.col("key").isNotNull()).join(again, "key", "left_anti").unionByName(settle(new))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates; rows of one ``doc_id`` are compared too."""
    words.bounded_batches(spark)
    rows = with_row_keys(docs)
    found = op5_near_dedup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text"), NEAR)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("key"))
    return rows.join(dropped, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return op2_mixing.mixed_documents(docs, weights=(3, 1, 2), total_share=1.5, most_copies=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in packed sequences."""
    words.bounded_batches(spark)
    return op10_packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", keep_clear_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and hashes have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
