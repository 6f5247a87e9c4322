"""Mix sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Each source's target is its share of ``total_share`` times all words by weight, but at most
``most_copies`` times its own words; what exceeds that is shared among the others by weight,
until no target is above. Targets are apportioned in blocks of ``BLOCK_WORDS`` words by
highest quotients, and each source's blocks to its shards in the same way, so every shard has
a whole quota.

A shard holds its documents in an order given by a seeded hash. Its quota covers all its words
as often as it can, and the rest is one run of blocks from a seeded start, around the end. So
at most two documents of a shard are taken in part, and reruns agree.

A null text has size 0 and takes nothing. Null sources are one source, behind all others.
Repeated rows and rows without key take part one by one. An empty table gives an empty result.
Columns of the input stay as they are; the ones that are added replace equal names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle

BLOCK_WORDS = 16
#: A source has about one shard for so many words, up to MOST_SHARDS.
SHARD_WORDS = 1 << 20
MOST_SHARDS = 4096
#: The table of sources goes to the driver; more different sources than this are an error.
MOST_SOURCES = 1_000_000
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def apportion(weights: Sequence[float], seats: int) -> list[int]:
    """Sainte-Lague: seats go one by one to the highest weight / (2 seats + 1)."""
    w = np.asarray(weights, np.float64)
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return [0] * len(w)
    # Rounding by one divisor is an apportionment of its own sum; single seats mend the sum.
    given = np.floor(w * (seats / w.sum()) + 0.5).astype(np.int64)
    while given.sum() < seats:
        given[np.argmax(w / (2 * given + 1))] += 1
    while given.sum() > seats:
        last = np.where(given > 0, w / np.maximum(2 * given - 1, 1), np.inf)
        given[len(w) - 1 - np.argmin(last[::-1])] -= 1
    return given.tolist()


def targets(
    sizes: Sequence[int], weights: Sequence[float], total_share: float, most_copies: float
) -> list[float]:
    """Words each source should give."""
    capped = [False] * len(sizes)
    total = total_share * sum(sizes)
    while True:
        free = [w for w, c in zip(weights, capped, strict=True) if not c]
        rest = total - sum(most_copies * s for s, c in zip(sizes, capped, strict=True) if c)
        level = rest / sum(free) if free else 0.0
        above = [
            not c and level * w > most_copies * s
            for s, w, c in zip(sizes, weights, capped, strict=True)
        ]
        if not any(above):
            return [
                float(most_copies * s) if c else level * w
                for s, w, c in zip(sizes, weights, capped, strict=True)
            ]
        capped = [c or a for c, a in zip(capped, above, strict=True)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    most_copies: int = 2,
    seed: int = 7,
) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with size, source_size, target and taken.

    ``weights`` repeat over the sources by code point, the null source last.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.col("doc_id"), F.lit(seed))
    fine = F.pmod(place, F.lit(MOST_SHARDS)).cast("int")
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    parts = settle(
        docs.select(name.alias("name"), fine.alias("fine"), word_count(F.col("text")).alias("n"))
        .groupBy("name", "fine")
        .agg(F.sum("n").alias("n"))
    )
    found = parts.groupBy("name").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["name"] == "-", r["name"]))
    sizes = [r["n"] for r in found]
    weight = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets(sizes, weight, total_share, most_copies)
    blocks = apportion(goal, round(sum(goal) / BLOCK_WORDS))
    shards = [
        min(MOST_SHARDS, 1 << max(0, (n - 1) // SHARD_WORDS).bit_length()) for n in sizes
    ]
    sources = spark.createDataFrame(
        [
            (r["name"], n, t, b, s)
            for r, n, t, b, s in zip(found, sizes, goal, blocks, shards, strict=True)
        ],
        "m_name string, m_size long, m_target double, m_blocks long, m_shards int",
    )

    # The driver knows the table's size: broadcast up to a bound, joined by shuffle beyond it.
    if sum(len(r["name"].encode()) + 40 for r in found) <= BROADCAST_BYTES:
        sources = F.broadcast(sources)

    def share_out(rows: pd.DataFrame) -> pd.DataFrame:  # the shards of one source, a bounded number
        rows = rows.sort_values("m_shard")
        quota = apportion(rows["m_words"].tolist(), int(rows["m_blocks"].iloc[0]))
        return rows.assign(m_quota=quota)[["m_name", "m_shard", "m_words", "m_quota"]]

    quotas = settle(
        parts.join(sources, F.col("name") == F.col("m_name"))
        .withColumn("m_shard", F.col("fine") % F.col("m_shards"))
        .groupBy("m_name", "m_shard", "m_blocks")
        .agg(F.sum("n").alias("m_words"))
        .groupBy("m_name")
        .applyInPandas(share_out, "m_name string, m_shard int, m_words long, m_quota long")
    )

    base = docs.select(
        F.struct("*").alias("m_row"),
        name.alias("m_key"),
        fine.alias("m_fine"),
        place.alias("m_place"),
        F.col("doc_id").alias("m_doc"),
        word_count(F.col("text")).alias("m_n"),
    )
    spread = base.join(sources, F.col("m_key") == F.col("m_name")).withColumn(
        "m_shard", F.col("m_fine") % F.col("m_shards")
    ).drop("m_name")
    order = Window.partitionBy("m_key", "m_shard").orderBy("m_place", "m_doc", "m_n")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = spread.withColumn("m_to", F.sum("m_n").over(order)).withColumn(
        "m_from", F.col("m_to") - F.col("m_n")
    )
    quotas = quotas.select(
        F.col("m_name"), F.col("m_shard").alias("m_of"), "m_words", "m_quota"
    )
    joined = laid.join(
        quotas, (F.col("m_key") == F.col("m_name")) & (F.col("m_shard") == F.col("m_of"))
    )

    words = F.greatest(F.col("m_words"), F.lit(1))
    wanted = F.col("m_quota") * BLOCK_WORDS
    whole = F.least(F.expr("m_quota * %d div greatest(m_words, 1)" % BLOCK_WORDS), F.lit(most_copies))
    rest = F.when(whole < most_copies, wanted - whole * words).otherwise(0)
    n_blocks = F.ceil(words / BLOCK_WORDS)
    start = F.pmod(F.xxhash64("m_key", "m_shard", F.lit(seed)), n_blocks) * BLOCK_WORDS

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(
            F.lit(0), F.least(F.col("m_to"), b) - F.greatest(F.col("m_from"), a)
        )

    run = overlap(start, start + rest) + overlap(F.lit(0), start + rest - words)
    taken = F.when(F.col("m_n") > 0, whole * F.col("m_n") + run).otherwise(0)
    added = {
        "size": F.col("m_n"),
        "source_size": F.col("m_size"),
        "target": F.col("m_target"),
        "taken": taken.cast("long"),
    }
    kept = [F.col("m_row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return joined.select(*kept, *[value.alias(c) for c, value in added.items()])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, rounded."""
    mixed = mix(docs.select(F.struct("*").alias("m_all"), "doc_id", "text", "source"), **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int"))
    return mixed.select("m_all", F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(0))))).select("m_all.*")
