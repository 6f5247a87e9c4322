"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut.
Lengths are whole numbers up to the capacity, so documents of one length are interchangeable,
and so are sequences with equal gaps. The matching therefore works on the two sorted
histograms, which never hold more than ``capacity`` sizes however many documents there are.

Each superstep takes all documents of the largest length that is left. Its sweep starts at
the successor of that length among the sorted gaps and takes gaps, the tightest first, until
all documents of the step are matched; what no gap can hold opens new sequences. Documents
that want the same gaps get them by their rank within their length. Then the gaps are updated
and the next step follows. The sweeps run one after another on the driver over the histograms
(``match``); there is no distributed sweep over a table of gaps. Spark sorts documents by range, ranks them, and places every
document by its rank; no task and no driver holds the documents of a length.

Null and empty texts are documents of the final id alone. Rows with null or repeated keys are
documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.functions.numbering import number_rows
from benchsieve.llm import words
from benchsieve.llm.tokenising import Encoder, cut_documents

CAPACITY = 4096
END_ID = 1


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text), on request ids."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_process(tokenizer)
        for batch in batches:
            for part in words.slices(batch):
                cut = cut_documents(encoder, part.column("text"), capacity, end_id)
                ids, first, length = cut.ids, cut.first, cut.length
                view = memoryview(ids)
                sums = [
                    zlib.crc32(view[a : a + n].cast("B") if n else b"")
                    for a, n in zip(first.tolist(), length.tolist(), strict=True)
                ]
                columns = [
                    part.column("doc_id").take(pa.array(cut.row)),
                    pa.array(cut.piece.astype(np.int32)),
                    pa.array(cut.start),
                    pa.array(length),
                    pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(read, schema + extra)


def match(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps of best fit over the histogram of lengths.

    Rows are (length, first rank, end rank, documents per sequence, first sequence, offset):
    document ``rank`` of the length goes to ``first sequence + (rank - first rank) // per`` at
    ``offset + (rank - first rank) % per * length``.
    """
    gaps: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []  # of gaps, sorted
    plan, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = gap // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, per, first, capacity - gap))
                leave(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            used = full
            if left and full < n:  # fewer documents are left than one more gap could take
                plan.append((length, rank, rank + left, left, first + full, capacity - gap))
                leave(gap - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            leave(gap, first + used, n - used)
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, which have a ``length`` to capacity.

    ``items`` are read twice, so they should be a written table.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = match(counts, capacity)
    plan = spark.createDataFrame(
        rows, "p_length long, p_from long, p_end long, p_per long, p_first long, p_offset long"
    )
    # Rows of equal lengths and keys are alike; the hash only makes the order total.
    ordered = items.withColumn("_row", F.monotonically_increasing_id())
    order = [c for c in ("doc_id", "piece") if c in items.columns]
    ranked = number_rows(ordered, [*order, "_row"], ["length"], "_rank")
    place = F.col("_rank") - 1 - F.col("p_from")
    return ranked.join(
        plan,
        (F.col("length") == F.col("p_length"))
        & (F.col("_rank") > F.col("p_from"))
        & (F.col("_rank") <= F.col("p_end")),
    ).select(
        *items.columns,
        (F.col("p_first") + F.floor(place / F.col("p_per"))).alias("sequence_id"),
        (F.col("p_offset") + F.pmod(place, F.col("p_per")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their place in sequences."""
    return pack(settle(pieces(docs, tokenizer, capacity)), capacity)
