"""Token shards: packed id matrices as binary files.

Each task encodes documents as they come and packs them in shards of about ``SHARD_TOKENS``
ids. Within a shard, pieces go by decreasing length to the sequence with the least gap that
holds them; a segment tree over the possible gaps finds it in the logarithm of the capacity.
Documents longer than a sequence are cut without loss into full pieces and a rest.

A shard is one .npz file in the shared folder: ``ids`` (one row per sequence, padded with 0,
two bytes per id when they fit), ``cumulative`` segment lengths of all sequences one behind
another with ``splits`` between the sequences, ``resets`` (bits that are set where positions
begin at 0), and doc_id, piece, start, row, offset and length of every segment. Files get new
names, and only those that finished tasks report are read, so lost tasks leave no trace.

Null and empty texts are documents of the final id alone. Rows with null or repeated keys are
documents of their own. An empty table writes nothing. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from benchsieve.functions.durable import new_folder, settle
from benchsieve.llm import words
from benchsieve.llm.tokenising import Encoder, cut_documents

CAPACITY = 4096
END_ID = 1
SHARD_TOKENS = 8 << 20
_NULL = -(2**63)


class GapTree:
    """Sequences by their gap, with the least gap of at least some size in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, gap: int, sequence: int) -> None:
        self.open[gap].append(sequence)
        node = gap + self.size
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a sequence with the smallest gap of ``least`` or more: (gap, sequence)."""
        node = least + self.size
        while not self.counts[node]:
            while node & 1:  # the right child of its parent: nothing further right here
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node *= 2
            node += not self.counts[node]
        gap = node - self.size
        while node:
            self.counts[node] -= 1
            node >>= 1
        return gap, self.open[gap].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences."""
    tree, opened = GapTree(capacity), 0
    row = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        gap, sequence = found
        row[i], offset[i] = sequence, capacity - gap
        if gap > length:
            tree.add(gap - length, sequence)
    return row, offset, opened


def shard_arrays(pieces: list[tuple[int | None, int, int, np.ndarray]], capacity: int) -> dict:
    """The arrays of a shard of pieces (doc_id, piece, start, ids)."""
    lengths = np.array([len(p[3]) for p in pieces], np.int64)
    row, offset, n = best_fit_decreasing(lengths, capacity)
    order = np.lexsort((offset, row))
    largest = max((int(p[3].max()) for p in pieces), default=0)
    ids = np.zeros((n, capacity), np.uint16 if largest < 1 << 16 else np.uint32)
    resets = np.zeros((n, capacity), bool)
    for i in order:
        ids[row[i], offset[i] : offset[i] + lengths[i]] = pieces[i][3]
        resets[row[i], offset[i]] = True
    ends = np.cumsum(lengths[order])
    splits = np.searchsorted(row[order], np.arange(n + 1))
    return {
        "ids": ids,
        "resets": np.packbits(resets, axis=1),
        "cumulative": np.concatenate([[0], ends]),
        "splits": splits,
        "doc_id": np.array([_NULL if pieces[i][0] is None else pieces[i][0] for i in order], np.int64),
        "piece": np.array([pieces[i][1] for i in order], np.int32),
        "start": np.array([pieces[i][2] for i in order], np.int64),
        "row": row[order],
        "offset": offset[order],
        "length": lengths[order],
    }


def positions(resets: np.ndarray, capacity: int) -> np.ndarray:
    """Position of each id within its segment (padding runs on)."""
    bits = np.unpackbits(resets, axis=1)[:, :capacity].astype(bool)
    at = np.arange(capacity)
    return at - np.maximum.accumulate(np.where(bits, at, 0), axis=1)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write ``docs`` (doc_id, text); the table (path, sequences, segments) of the shards."""
    folder = folder or new_folder(docs.sparkSession)

    def save(held: list[tuple]) -> tuple[str, int, int]:
        arrays = shard_arrays(held, capacity)
        out = io.BytesIO()
        np.savez(out, **arrays)
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name, compression=None) as stream:
            stream.write(out.getbuffer())
        return path, len(arrays["ids"]), len(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_process(tokenizer)
        held: list[tuple] = []
        done, size = [], 0
        for batch in batches:
            for part in words.slices(batch):
                keys = part.column("doc_id").to_pylist()
                cut = cut_documents(encoder, part.column("text"), capacity, end_id)
                ids = cut.ids.astype(np.uint16) if cut.ids.max(initial=0) < 1 << 16 else cut.ids
                for i, row in enumerate(cut.row):
                    first, length = cut.first[i], cut.length[i]
                    held.append((keys[row], cut.piece[i], cut.start[i], ids[first : first + length]))
                    size += length
                    if size >= shard_tokens:
                        done.append(save(held))
                        held, size = [], 0
        if held:
            done.append(save(held))
        columns = zip(*done, strict=True) if done else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["path", "sequences", "segments"],
        )

    written = docs.select("doc_id", "text").mapInArrow(
        write, "path string, sequences long, segments long"
    )
    return settle(written)


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per segment of ``shards`` (path, segments), from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, segments in zip(batch.column("path"), batch.column("segments"), strict=True):
                where, name = fs.FileSystem.from_uri(path.as_py())
                with where.open_input_stream(name, compression=None) as stream:
                    shard = dict(np.load(io.BytesIO(stream.read())))
                yield from _segments(path.as_py(), shard, segments.as_py())

    return shards.select("path", "segments").mapInArrow(
        read,
        "doc_id long, piece int, start long, length long, ids_crc32 long, shard string, "
        "sequence long, offset long",
    )


def _segments(path: str, shard: dict, segments: int) -> Iterator[pa.RecordBatch]:
    """Check a shard's parts against each other and list its segments."""
    ids, row, offset, length = (shard[c] for c in ("ids", "row", "offset", "length"))
    place = positions(shard["resets"], ids.shape[1])
    good = (
        len(row) == segments
        and (np.diff(shard["cumulative"]) == length).all()
        and (np.searchsorted(row, np.arange(len(ids) + 1)) == shard["splits"]).all()
        and (place[row, offset + length - 1] == length - 1).all()
        and (place[row, offset] == 0).all()
    )
    if not good:
        raise ValueError(f"the parts of {path} do not fit each other")
    sums = [
        zlib.crc32(ids[r, a : a + n].astype("<u4").tobytes())
        for r, a, n in zip(row, offset, length, strict=True)
    ]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(shard["doc_id"], mask=shard["doc_id"] == _NULL),
            pa.array(shard["piece"]),
            pa.array(shard["start"]),
            pa.array(length),
            pa.array(sums, pa.int64()),
            pa.array([path] * len(row), pa.string()),
            pa.array(row),
            pa.array(offset),
        ],
        ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "sequence", "offset"],
    )
