"""Links between similar shingle sets without pairs of whole groups, and their components.

``similar_links`` takes a table of distinct sets with band keys. Each bucket of equal band
keys is linked as a star around its smallest id. Buckets whose members still lie in several
components afterwards are open. Their sets are narrowed by prefixes: shingles in one order, the
rarest first, of which similar sets must share one near their beginnings, at places that leave
enough behind. So members of a template that are alike but not similar are never paired, and
members of one component are not paired with each other. Every link is confirmed by ``confirm``,
so false candidates cost time and never a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import words

#: Takes pairs (a, b) and returns those that are linked.
Confirm = Callable[[DataFrame], DataFrame]
#: Takes sets (id, component) and returns their prefixes.
Prefixes = Callable[[DataFrame], DataFrame]
#: Cells of hashed counts that put shingles in order; a fixed size.
ORDER_CELLS = 1 << 20
#: Says from two prefixed rows of sets whether a candidate is worth confirming.
Likely = Callable[[Column, Column], Column]


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for linked ids.

    Large and small stars by turns; each round is written, so a lost executor costs little.
    """
    links = settle(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.where(F.col("b") > F.col("a")).join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        links = settle(small)
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        before = state


def confirm_on_texts(docs: DataFrame, percent: int) -> Confirm:
    """Keep pairs of ``doc_id`` whose shingle sets meet 100 * common >= percent * united.

    Only texts of documents in a pair are moved.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text_a"):
                left = words.distinct(*words.shingle_hashes(part.column("text_a")))
                right = words.distinct(*words.shingle_hashes(part.column("text_b")))
                same = np.array(
                    [
                        len(np.intersect1d(a, b, assume_unique=True))
                        for a, b in zip(left, right, strict=True)
                    ],
                    np.int64,
                )
                union = np.array([len(a) for a in left]) + [len(b) for b in right] - same
                kept = pa.array((100 * same >= percent * union) & (same > 0))
                yield part.select(["a", "b"]).filter(kept)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = settle(docs.join(ids, "doc_id", "left_semi"))
        return (
            pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(check, "a long, b long")
        )

    return confirm


def rare_prefixes(docs: DataFrame, percent: int) -> Prefixes:
    """Prefixes (id, component, size, place, token, in_index) of the shingle sets of ``doc_id``.

    Shingles stand in the order of their hashed counts over all sets asked for, then of their
    hashes. Of two similar sets the shorter, or by id the first, has the first common shingle
    among those ``in_index``, the other among all that are returned.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for part in words.slices(batch):
                yield part, words.distinct(*words.shingle_hashes(part.column("text")))

    def cells(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(ORDER_CELLS - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ORDER_CELLS, np.int64)
        for _, sets in sets_of(batches):
            if sets:
                sums += np.bincount(cells(np.concatenate(sets)), minlength=ORDER_CELLS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "n": pa.array(sums[used])})

    def prefixes(asked: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(asked, "id")
        texts = settle(texts.select("id", "component", "text"))
        counted = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        rarity = np.zeros(ORDER_CELLS, np.uint32)
        rarity[counted["cell"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in sets_of(batches):
                sizes = np.array([len(s) for s in sets], np.int64)
                kept = np.where(sizes > 0, sizes + -percent * sizes // 100 + 1, 0)
                indexed = sizes + -2 * percent * sizes // (100 + percent) + 1
                first = [s[np.lexsort((s, rarity[cells(s)]))[:n]] for s, n in zip(sets, kept, strict=True)]
                row = np.repeat(np.arange(len(sets)), kept)
                place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
                tokens = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id").take(pa.array(row)),
                        "component": part.column("component").take(pa.array(row)),
                        "size": pa.array(sizes[row]),
                        "place": pa.array(place),
                        "token": pa.array(tokens),
                        "in_index": pa.array(place < indexed[row]),
                    }
                )

        schema = "id long, component long, size long, place long, token long, in_index boolean"
        return texts.mapInArrow(cut, schema)

    return prefixes


def narrowed(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that their prefixes allow to be similar.

    A token's members are paired only if it is in the index of one of them, and those of the
    token's largest component only with the others.
    """
    spans = prefixes.groupBy("token").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.bool_or("in_index").alias("_any")
    )
    mixed = spans.where((F.col("_low") < F.col("_high")) & F.col("_any")).select("token")
    rows = settle(prefixes.join(mixed, "token"))
    counts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    rows = settle(rows.join(largest, "token").withColumn("minor", F.col("component") != F.col("major")).drop("major"))
    index, other = (
        rows.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "size", "place", "in_index", "minor")])
        for x in "ab"
    )
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (
        (F.col("component_a") != F.col("component_b"))
        & (F.struct("size_a", "id_a") < F.struct("size_b", "id_b"))
        & (100 * F.col("size_a") >= percent * F.col("size_b"))
        & ((100 + percent) * left >= percent * (F.col("size_a") + F.col("size_b")))
    )
    index = index.where("in_index_a")
    found = index.where("minor_a").join(other, "token").where(fits)
    found = found.unionByName(index.where("not minor_a").join(other.where("minor_b"), "token").where(fits))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def similar_links(
    sets: DataFrame, likely: Likely, confirm: Confirm, prefixes: Prefixes, percent: int
) -> DataFrame:
    """Confirmed links (a, b) that connect similar ``sets`` (id, keys, sketch).

    ``keys`` are the band keys. The links join all sets that are reachable over similar
    pairs that share a band; pairs within a component already joined are left out.
    """
    sketches = sets.select("id", "sketch")
    members = sets.select("id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    shared = settle(members.join(buckets.where(F.col("n") > 1), "key"))
    stars = shared.where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    compared = (
        stars.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("_b")), "b")
        .join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("_a")), "a")
        .where(likely(F.col("_a"), F.col("_b")))
        .select("a", "b")
    )
    links = settle(confirm(compared))
    joined = components(links)

    # Buckets of two are done. Larger ones may hold similar sets that no star has joined.
    left = (
        shared.where(F.col("n") > 2)
        .select("key", "id")
        .join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    open_keys = (
        left.groupBy("key")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where(F.col("_low") < F.col("_high"))
        .select("key")
    )
    rest = settle(left.join(open_keys, "key").select("id", "component").distinct())
    crossing = narrowed(prefixes(rest), percent)
    crossing = (
        crossing.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("_b")), "b")
        .join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("_a")), "a")
        .where(likely(F.col("_a"), F.col("_b")))
        .select("a", "b")
    )
    return links.unionByName(settle(confirm(crossing)))
