"""Words, word shingles and MinHash signatures of whole Arrow batches in numpy.

A word is a run of characters other than ASCII white space, A-Z lower-cased. A
document's shingles are its runs of five words; a shorter document has its whole word
sequence as one shingle; a document without words or text has none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

SHINGLE_WORDS = 5
#: Texts are worked on in slices of about so many bytes; one longer text is one slice.
SLICE_BYTES = 3 << 20
#: Texts go from executors to their Python workers in batches of about so many bytes.
BATCH_BYTES = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINISH = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def bounded_batches(spark: SparkSession) -> None:
    """Let the session move rows to Python in batches of at most ``BATCH_BYTES``.

    The default bounds rows (10,000) and bytes (64 MB), which executor and worker both
    hold once or twice per task. A lower bound given in plain bytes stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key).lower().removesuffix("b")
    if not bound.isdecimal() or int(bound) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(
    batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part take ``most`` bytes or are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)
    release_memory()


def release_memory() -> None:
    """Give what a worker has freed back to the machine, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


class Tokens:
    """White-space separated tokens of texts: ``distinct`` ones, ``codes``, row ``bounds``."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if len(lists) == 0:
            self.distinct = pa.array([], pa.string())
            self.codes, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        flat = lists.flatten()
        kept = pc.greater(pc.binary_length(flat), 0)
        ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
        offsets = lists.offsets.to_numpy()
        encoded = flat.filter(kept).dictionary_encode()
        self.distinct = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = ends[offsets - offsets[0]].astype(np.int64)

    @cached_property
    def values(self) -> list[str]:
        return self.distinct.to_pylist()

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive bounds."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return ends[bounds[1:]] - ends[bounds[:-1]]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FINISH[0]
    h = (h ^ (h >> np.uint64(27))) * _FINISH[1]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles with repeats, and the bounds of each text's hashes."""
    tokens = Tokens(texts)
    hashed = (xxhash.xxh3_64_intdigest(v.encode().lower()) for v in tokens.values)
    words = np.fromiter(hashed, np.uint64, len(tokens.values))[tokens.codes]
    sizes, first = tokens.sizes, tokens.bounds[:-1]
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.zeros(bounds[-1], np.uint64)
    if len(words) >= width:
        runs = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            runs = runs * _MIX + words[i : i + len(runs)]
        places = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(first, counts)
        whole = np.repeat(sizes >= width, counts)
        out[whole] = runs[places[whole]]
    for row in np.flatnonzero((sizes > 0) & (sizes < width)):
        h = int(sizes[row])
        for word in words[tokens.bounds[row] : tokens.bounds[row + 1]]:
            h = (h * int(_MIX) + int(word)) & (2**64 - 1)
        out[bounds[row]] = h
    return _finish(out), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Permutations:
    """Universal hash permutations x -> a x + b modulo 2**32, a odd, from one seed."""

    def __init__(self, count: int, seed: int):
        draw = np.random.default_rng(seed)
        self.factors = draw.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)
        self.offsets = draw.integers(0, 2**32, count, dtype=np.uint32)

    def signatures(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Row minima of every permutation; a text without shingles has all ones."""
        rows = len(bounds) - 1
        out = np.full((rows, len(self.factors)), 0xFFFFFFFF, np.uint32)
        filled = np.flatnonzero(np.diff(bounds))
        values = (hashes >> np.uint64(32)).astype(np.uint32)
        start = 0
        while start < len(filled):  # parts that fit a processor's cache
            low = bounds[filled[start]]
            stop = np.searchsorted(bounds[filled + 1], low + 65536, "right")
            stop = max(int(stop), start + 1)
            part = filled[start:stop]
            chunk = values[low : bounds[part[-1] + 1]]
            starts = bounds[part] - low
            work = np.empty_like(chunk)
            for k in range(len(self.factors)):
                np.multiply(chunk, self.factors[k], out=work)
                np.add(work, self.offsets[k], out=work)
                out[part, k] = np.minimum.reduceat(work, starts)
            start = stop
        return out
