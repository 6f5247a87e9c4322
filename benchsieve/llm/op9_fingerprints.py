"""MinHash fingerprints of whole texts.

A fingerprint holds four bits of each of ``SAMPLES`` minima of universal hash permutations over
a text's word shingles, as hexadecimal digits. The share of equal digits, less what chance
makes equal, estimates the Jaccard likeness of two texts with a standard error of about 0.03.
A text without words has the empty fingerprint, which is like itself alone. Texts of less
than five words have one shingle, their whole word sequence. Null texts count as empty.

``near_duplicates`` joins bands of whole signatures in Spark and verifies the Jaccard
likeness of each candidate on the full shingle sets; ``near_documents`` gives every row the
component of its links. A pair at 0.8 shares none of the 36 bands of 7 with probability 2e-4.

Documents follow each other by descending ``doc_id``, equal ones by their text; those without
``doc_id`` come last, in the order of a hash of their texts. Behind the last comes the first. An only document follows itself. An empty
table gives an empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import linking, words
from benchsieve.llm.op5_near_dedup import band_keys, lists

SAMPLES = 256
SEED = 9_2024
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures, and which texts have any shingle."""
    hashes, bounds = words.shingle_hashes(texts)
    return words.Permutations(SAMPLES, SEED).signatures(hashes, bounds), np.diff(bounds) > 0


def digits(signature: np.ndarray) -> np.ndarray:
    """Four mixed bits of each minimum, whose own first bits are nearly always 0."""
    return (signature * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, full_a: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of digits; of two empty texts it is 1."""
    share = (a == b).mean(1)
    estimate = np.clip((share - 1 / 16) / (1 - 1 / 16), 0.0, 1.0)
    return np.where(full_a & full_b, estimate, (~full_a & ~full_b).astype(np.float64))


def fingerprint_strings(rows: np.ndarray, full: np.ndarray) -> list[str]:
    text = _HEX[rows].tobytes().decode()
    width = rows.shape[1]
    return [text[i * width : (i + 1) * width] if f else "" for i, f in enumerate(full)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row of ``docs`` (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                signature, full = signatures(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(fingerprint_strings(digits(signature), full)),
                    ],
                    ["doc_id", "n_chars", "fingerprint"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        read, f"doc_id {key}, n_chars long, fingerprint string"
    )


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of four-bit digits as rows of 64-bit integers."""
    return np.ascontiguousarray(rows[:, ::2] << 4 | rows[:, 1::2]).view(np.int64)


def differing_digits(a: Column, b: Column) -> Column:
    """How many four-bit digits of two arrays of 64-bit integers differ."""

    def marked(x: Column, y: Column) -> Column:
        changed = x.bitwiseXOR(y)
        for shift in (1, 2):  # each digit's lowest bit becomes whether any of its bits is set
            changed = changed.bitwiseOR(F.shiftrightunsigned(changed, shift))
        return F.bit_count(changed.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, marked), F.lit(0), lambda s, n: s + n)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Verified links (a, b) that connect documents with similar shingle sets.

    Documents of equal sets are one class, linked to its smallest ``doc_id``; bands are joined
    between classes.
    """
    rows, bands = 7, SAMPLES // 7

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = words.Permutations(SAMPLES, SEED)
        for batch in batches:
            for part in words.slices(batch):
                hashes, bounds = words.shingle_hashes(part.column("text"))
                signature = draws.signatures(hashes, bounds)
                sets = words.distinct(hashes, bounds)
                full = np.diff(bounds) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        lists(band_keys(signature, rows, bands)),
                        lists(packed(digits(signature))),
                    ],
                    ["id", "digest", "keys", "sketch"],
                ).filter(pa.array(full & part.column("doc_id").is_valid().to_numpy(False)))

    # A pair at the threshold has so many equal digits, by chance too, less five deviations.
    share = percent / 100 + (1 - percent / 100) / 16 - 0.15

    def likely(a: Column, b: Column) -> Column:
        return differing_digits(a, b) <= SAMPLES * (1 - share)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = settle(docs.mapInArrow(read, "id long, digest binary, keys array<long>, sketch array<long>"))
    classes = settle(
        sets.groupBy("digest").agg(
            F.min("id").alias("id"), F.min_by("keys", "id").alias("keys"), F.min_by("sketch", "id").alias("sketch")
        )
    )
    equal = sets.select("id", "digest").join(classes.select("digest", F.col("id").alias("a")), "digest")
    equal = equal.where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    similar = linking.similar_links(
        classes.select("id", "keys", "sketch"),
        likely,
        linking.confirm_on_texts(docs, percent),
        linking.rare_prefixes(docs, percent),
        percent,
    )
    return similar.unionByName(equal)


def near_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest ``doc_id`` reachable over links.

    Rows of one ``doc_id`` are one document; rows without it have no component.
    """
    found = settle(linking.components(near_duplicates(docs, percent)))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = found.select(F.col("id").alias("doc_id"), "component")
    return keys.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many sorted ``bounds`` are below ``value``, by a binary search."""
    padded = padded_bounds(bounds)
    return place_in(value, F.array(*[F.lit(b) for b in padded]), len(bounds).bit_length())


def padded_bounds(bounds: list[int]) -> list[int]:
    return bounds + [2**63 - 1] * (2 ** len(bounds).bit_length() - len(bounds))


def place_in(value: Column, table: Column, levels: int) -> Column:
    """``bucket_of`` for an array column of 2 ** ``levels`` padded bounds."""
    if not levels:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(levels))]),
        F.lit(0),
        lambda low, step: low + F.when(F.element_at(table, low + step) < value, step).otherwise(0),
    )


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text), sorted for one sweep per bucket.

    Buckets are ranges of keys from quantiles. Rows without a key come last; they are dealt
    over buckets of their own by a hash of their texts. The first row of a bucket is also
    sent, marked ``ahead``, to the end of the bucket before it, so texts move once. Bounds and
    first rows are small tables with a row or an entry per bucket, so the size of expressions
    does not grow with the buckets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    rows = rows.withColumn("top", F.coalesce("key", F.xxhash64("text")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # More ranges than tasks, so that tasks get about equal shares of them.
    ranges = 4 * parts
    wanted = [i / ranges for i in range(1, ranges)]
    found, count, keyless = rows.agg(
        F.percentile_approx("key", wanted, 20 * ranges), F.count(F.lit(1)), F.count_if(F.col("key").isNull())
    ).first()
    bounds = sorted(set(found or []))
    held = spark.createDataFrame([(1, padded_bounds(bounds))], "one int, bounds array<bigint>")
    ranged = place_in(F.col("key"), F.col("bounds"), len(bounds).bit_length())
    dealt = -1 - F.pmod("top", F.lit(max(1, -(-ranges * keyless // max(count, 1)))))
    bucket = F.when(F.col("key").isNull(), dealt.cast("int")).otherwise(ranged)
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(held), "one").withColumn("bucket", bucket)
    rows = rows.drop("one", "bounds")
    # One row per bucket, and so per partition.
    heads = rows.groupBy("bucket").agg(F.max("top").alias("top")).collect()
    heads.sort(key=lambda r: -r["bucket"])
    targets = spark.createDataFrame(
        [(r["bucket"], r["top"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)],
        "bucket int, top long, h_bucket int",
    )
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("h_bucket").alias("bucket"), F.lit(True).alias("ahead"))
    return (
        rows.join(F.broadcast(targets), ["bucket", "top"], "left")
        .withColumn("place", F.explode(F.when(F.col("h_bucket").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("place.bucket", "place.ahead", "top", "doc_id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "ahead", F.desc("top"), "text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and their likeness.

    The edited text has its last third (rounded down) replaced by the first as many characters
    of the next document.
    """

    def compare(run: list[tuple]) -> pa.RecordBatch:
        """Rows (doc_id, text) with the next text behind the last."""
        texts = [t for _, t in run]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + after[:cut])
        signature, full = signatures(pa.array(texts, pa.string()))
        new_signature, new_full = signatures(pa.array(edited, pa.string()))
        old, new = digits(signature), digits(new_signature)
        names = fingerprint_strings(old, full)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in run[:-1]], key_type),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(names[:-1], pa.string()),
                pa.array(fingerprint_strings(new, new_full), pa.string()),
                pa.array(likeness(old[:-1], new, full[:-1], new_full)),
                pa.array(likeness(old[:-1], old[1:], full[:-1], full[1:])),
            ],
            [
                "doc_id",
                "n_chars",
                "edited_sha256",
                "fingerprint",
                "edited_fingerprint",
                "near_edited",
                "near_next",
            ],
        )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        bucket, size, done = None, 0, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))
            for place, ahead, doc_id, text in zip(*columns, strict=True):
                if place != bucket:
                    bucket, run, size, done = place, [], 0, False
                if done:  # a further row with the key of the first
                    continue
                run.append((doc_id, text or ""))
                size += len(run[-1][1])
                done = ahead
                if len(run) > 1 and (ahead or size > words.SLICE_BYTES // 2):
                    yield compare(run)
                    run, size = run[-1:], len(run[-1][1])

    docs = docs.select("doc_id", "text")
    key_type = pa.int64()
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return in_order(docs).select("bucket", "ahead", "doc_id", "text").mapInArrow(sweep, schema)
