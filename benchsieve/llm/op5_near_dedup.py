"""Near-duplicate documents by odd sketches.

Each document's set of word shingles gets a MinHash signature. Rows of the signature form
band keys that bring similar sets together; all samples are folded into a bitmap that holds
the parity of the samples that fall on each bit. The bits in which two bitmaps differ
estimate the difference of the sets, so a candidate is dismissed by exclusive or and a count
of bits. What remains is confirmed on the full shingle sets of whole texts.

Documents with equal sets form a class beforehand, so only one of them takes part.

Null and empty texts and texts of white space have no shingles and link with nothing. Rows
that repeat a ``doc_id`` are one document, linked by any of their texts and kept or dropped
together. Rows without ``doc_id`` take the component of their set and are kept. An empty
table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import linking, words

SEED = 20_05
SKETCH_BITS = 2048


@dataclass(frozen=True)
class NearDedup:
    """Link sets with intersection / union >= percent / 100.

    A pair at the threshold shares no band with probability (1 - t**rows)**bands, below 2e-5
    for both settings in use (85 with 8 x 40; 80 with 7 x 48). The sketch test lets pairs
    pass whose estimate lies up to ``slack`` below the threshold, which is five standard
    deviations of an estimate from ``samples`` samples.
    """

    percent: int = 85
    rows: int = 8
    bands: int = 40
    samples: int = 1024
    slack: float = 0.06

    @property
    def most_bits(self) -> int:
        """Differing bits expected at the lowest similarity that still passes."""
        changed = 2 * self.samples * (1 - (self.percent / 100 - self.slack))
        return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * changed / SKETCH_BITS)))


def odd_sketch(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (place, sample) pairs, as rows of 64-bit integers."""
    rows, samples = signatures.shape
    places = np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = (signatures.astype(np.uint64) + places) * np.uint64(0xD6E8FEB86659FD93)
    bit = (bit ^ (bit >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(53)
    counts = np.zeros((rows, SKETCH_BITS), np.uint16)
    np.add.at(counts, (np.arange(rows)[:, None], bit.astype(np.int64)), 1)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.int64)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per run of ``rows`` samples, different for equal runs of other bands."""
    out = np.empty((len(signatures), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(signatures), band + 1, np.uint64)
        for k in range(rows):
            h = h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, band * rows + k]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, band] = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def shingle_sets(docs: DataFrame, spec: NearDedup) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, sketch) of each row of ``docs`` (doc_id, text)."""
    draws = words.Permutations(spec.samples, SEED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                hashes, bounds = words.shingle_hashes(part.column("text"))
                sets = words.distinct(hashes, bounds)
                signatures = draws.signatures(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        lists(band_keys(signatures, spec.rows, spec.bands)),
                        lists(odd_sketch(signatures)),
                    ],
                    ["doc_id", "n_shingles", "digest", "keys", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        read,
        "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>",
    )


def repeated_classes(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, a, b): each class b of a repeated document, and the smallest of them."""
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    held = settle(
        known.join(again, "doc_id", "left_semi")
        .select("doc_id", "digest")
        .join(classes.select("digest", "id"), "digest")
        .select("doc_id", F.col("id").alias("b"))
        .distinct()
    )
    return held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id")


def near_duplicates(docs: DataFrame, spec: NearDedup = NearDedup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = settle(shingle_sets(docs, spec))
    known = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("digest").agg(
        F.min("doc_id").alias("id"),
        F.min_by("keys", "doc_id").alias("keys"),
        F.min_by("sketch", "doc_id").alias("sketch"),
    )
    classes = settle(classes)

    def likely(a: Column, b: Column) -> Column:
        differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(differing, F.lit(0), lambda s, x: s + x) <= spec.most_bits

    links = linking.similar_links(
        classes.select("id", "keys", "sketch"),
        likely,
        linking.confirm_on_texts(docs, spec.percent),
        linking.rare_prefixes(docs, spec.percent),
        spec.percent,
    )
    # The classes of a repeated document belong together.
    repeated = settle(repeated_classes(sets.where(F.col("doc_id").isNotNull()), classes))
    found = settle(linking.components(links.unionByName(repeated.select("a", "b"))))
    own = repeated.select("doc_id", F.col("a").alias("id")).distinct().join(found, "id", "left")
    own = settle(own.select("doc_id", F.coalesce("component", "id").alias("own")))
    resolved = classes.select("digest", "id").join(found, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    return (
        sets.select("doc_id", "n_shingles", "digest")
        .join(resolved, "digest", "left")
        .join(own, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component"))
            .otherwise(F.coalesce("own", "doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
