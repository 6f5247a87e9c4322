"""Spelling variants: words one edit apart, grouped under their most frequent form.

Two words one edit apart share a bigram that the edit left whole. Each word has a prefix, its
bigrams up to the third rarest, and two pivots: the cheapest pair of disjoint bigrams of the
prefix, found by dynamic programming over positions. One edit hits at most one of two disjoint
bigrams, so of two near words the one whose prefix ends first in the order of rarity has a
pivot that is in the other's prefix. The order is that of the bigrams' counts over all words.

Position limits: a whole pivot leaves the edit on one side, so the other sides are equal, and the
pivot is as far from that end in both words. On the side with the edit one half is equal too,
counted from the pivot or from the end. A key of the index holds the bigram, its place and those
equal parts, as 64 bits; words that meet in a key are verified on their code points. Alphabets
have 90 letters, so there are at most 8,100 bigrams, which is what goes to every task.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. Null and empty
texts have none. Rows with repeated keys are counted each; a null key counts as an empty one.
Texts are read whole. Equal counts go to the smaller word by code point. Empty tables give empty
results. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import words

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variants.
TIMES = 5
#: One of so many runs of a document is misspelt.
MISSPELT = 199

_FIRST, _LAST = 0xC0, 0xFF
_LETTERS = 26 + _LAST - _FIRST + 1
_RARE = 3
#: Letters that are worked on at once.
_CELLS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

# Bytes of UTF-8: C3 leads all of U+00C0 to U+00FF and nothing else.
_LEAD = 0xC3
_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x61:0x7B] = _LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)

# One zero byte more in a CRC-32 register, by its low byte; a rule gives the 256 entries.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def only_runs(texts: pa.Array) -> pa.Array:
    """Texts with letters lower-cased and all other bytes as spaces, byte for byte."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    out = _LOWER[data]
    lead = np.flatnonzero(data == _LEAD)
    out[lead] = _LEAD
    out[lead + 1] = data[lead + 1]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(out))


def run_hashes(prefixes: list[bytes], runs: words.Tokens) -> np.ndarray:
    """CRC-32 of each row's prefix and each of its runs, in the order of the runs."""
    crc = np.fromiter((zlib.crc32(v.encode()) for v in runs.values), np.uint32, len(runs.distinct))
    sizes = pc.binary_length(runs.distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(prefixes)), runs.sizes)
    heads = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    out = np.zeros(len(runs.codes), np.uint32)
    used = np.unique(sizes)
    short = used[used <= 64]
    # The heads advanced by every usual length of a run, a table of rows by lengths.
    moved = np.zeros((65, len(prefixes)), np.uint32)
    for k in range(int(short.max(initial=0)) + 1):
        moved[k] = heads
        heads = _CRC[heads & np.uint32(0xFF)] ^ (heads >> np.uint32(8))
    length = sizes[runs.codes]
    usual = length <= 64
    out[usual] = moved[length[usual], row[usual]] ^ crc[runs.codes[usual]]
    for at in np.flatnonzero(~usual):
        out[at] = zlib.crc32(prefixes[row[at]] + runs.values[runs.codes[at]].encode())
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            runs = words.Tokens(only_runs(part.column("text")))
            keys = part.column("doc_id").cast(pa.string())
            prefixes = [f"{k.as_py() or ''}:".encode() for k in keys]
            hashes = run_hashes(prefixes, runs)
            hit = hashes % MISSPELT == 0
            letters = pc.utf8_length(runs.distinct).to_numpy(zero_copy_only=False)
            counts = np.bincount(runs.codes[~hit], minlength=len(runs.distinct))
            kept = (counts > 0) & (letters >= LEAST_LETTERS)
            names, sums = runs.distinct.filter(pa.array(kept)).to_pylist(), counts[kept].tolist()
            for code, h in zip(runs.codes[hit].tolist(), hashes[hit].tolist(), strict=True):
                run = runs.values[code]
                if len(run) > LEAST_LETTERS:
                    at = h % len(run)
                    names.append(run[:at] + run[at + 1 :])
                    sums.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text) after misspelling, n being ``least`` or more."""
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letter_codes(code_points: np.ndarray) -> np.ndarray:
    return np.where(code_points < 128, code_points - 0x61, code_points - _FIRST + 26)


def pivots(costs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two disjoint bigrams of each row's prefix whose costs sum least.

    Dynamic programming over positions: the best first pivot at least two places before each
    second one. Rows are words of one length, columns their bigrams.
    """
    rows = np.arange(len(costs))
    cost = np.where(prefix, costs.astype(np.float64), np.inf)
    best, best_at = np.full(len(costs), np.inf), np.zeros(len(costs), np.int64)
    least, first, second = best.copy(), best_at.copy(), best_at.copy()
    for at in range(2, cost.shape[1]):
        better = cost[rows, at - 2] < best
        best, best_at = np.where(better, cost[:, at - 2], best), np.where(better, at - 2, best_at)
        better = best + cost[:, at] < least
        least = np.where(better, best + cost[:, at], least)
        first, second = np.where(better, best_at, first), np.where(better, at, second)
    return first, second


class LetterSums:
    """Hashes of any run of letters in rows of one length, from running sums of powers."""

    def __init__(self, codes: np.ndarray):
        self.length = codes.shape[1]
        self.powers = np.cumprod(np.full(self.length + 1, _BASE)) * _BASE_INVERSE
        self.inverse = np.cumprod(np.full(self.length + 1, _BASE_INVERSE)) * _BASE
        terms = (codes + 1).astype(np.uint64) * self.powers[: self.length]
        self.sums = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)

    def of(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[row, end] - self.sums[row, start]) * self.inverse[start]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.uint64(0)
    for part in parts:
        h = (h ^ part.astype(np.uint64)) * _MIX
        h = h ^ (h >> np.uint64(29))
    return h


def index_keys(codes: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, whether they hold) of bigrams ``at`` of words ``row``, for each kind of key.

    ``codes`` are the letters of words of one length.
    """
    length, start = codes.shape[1], np.zeros(len(at), np.int64)
    for side, letters, place in ((0, codes, at), (1, codes[:, ::-1], length - 2 - at)):
        sums = LetterSums(letters)
        # Up to the end of the bigram both words are equal; the edit is behind it.
        head, behind = sums.of(row, start, place + 2), length - place - 2
        for longer in (0, 1):  # by so much this word may exceed the other
            common = behind - longer
            fits = common >= 0
            half = np.maximum(common, 0) // 2
            near = sums.of(row, place + 2, place + 2 + half)
            far = sums.of(row, length - (np.maximum(common, 0) - half), start + length)
            for kind, part in enumerate((near, far)):
                yield _mixed(head, common + 2, start + 2 * side + kind, part), fits


def _index(costs: np.ndarray, ranks: np.ndarray, only_pivots: bool):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes):
                chosen = np.flatnonzero(sizes == length)
                most = max(1, _CELLS // int(length))
                for start in range(0, len(chosen), most):
                    yield rows_of(batch.take(pa.array(chosen[start : start + most])), int(length))

    def rows_of(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
        text = "".join(part.column("word").to_pylist()).encode("utf-32-le")
        codes = _letter_codes(np.frombuffer(text, np.uint32).astype(np.int64)).reshape(-1, length)
        grams = codes[:, :-1] * _LETTERS + codes[:, 1:]
        rank = ranks[grams]
        last = np.partition(rank, _RARE - 1, axis=1)[:, _RARE - 1]
        prefix = rank <= last[:, None]
        if only_pivots:
            row = np.tile(np.arange(len(codes)), 2)
            at = np.concatenate(pivots(costs[grams], prefix))
        else:
            row, at = np.nonzero(prefix)
        kinds = list(index_keys(codes, row, at))
        fits = np.concatenate([f for _, f in kinds])
        keys = np.concatenate([k for k, _ in kinds])[fits].view(np.int64)
        where = pa.array(np.tile(row, len(kinds))[fits])
        columns = [pa.array(keys), part.column("word").take(where), part.column("n").take(where)]
        return pa.RecordBatch.from_arrays(columns, ["key", "word", "n"])

    return keyed


def near_words(counted: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n), both ways, of ``counted`` (word, n), at least 6 letters.

    ``counted`` is read three times, so it should be a written table. It has no word twice.
    """
    starts = F.sequence(F.lit(1), F.length("word") - 1)
    spots = F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(2)))
    grams = counted.select(F.explode(spots).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    costs = np.zeros(_LETTERS * _LETTERS, np.int64)
    for r in grams.collect():  # at most _LETTERS squared rows
        a, b = _letter_codes(np.array([ord(c) for c in r["gram"]]))
        costs[a * _LETTERS + b] = r["n"]
    ranks = np.empty(len(costs), np.int64)
    ranks[np.argsort(costs, kind="stable")] = np.arange(len(costs))

    schema = "key long, word string, n long"
    mine = counted.mapInArrow(_index(costs, ranks, only_pivots=True), schema)
    theirs = counted.mapInArrow(_index(costs, ranks, only_pivots=False), schema)
    theirs = theirs.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    close = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    # A word has many keys, which the planner does not see: it takes both sides for as small as ``counted``.
    pairs = mine.join(theirs.hint("merge"), (mine["key"] == theirs["key"]) & close).select("word", "n", "near", "near_n")
    # Each pair is wanted from both its words, however many keys hold it.
    ways = F.inline(
        F.array(
            F.struct("word", "n", "near", "near_n"),
            F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    )
    return pairs.select(ways).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form) ends, by doubling its steps.

    Counts grow ``TIMES``-fold along a chain, so six rounds reach the end of any.
    """
    step = settle(forms)
    while True:
        onward = step.select(F.col("word").alias("form"), F.col("form").alias("further"))
        step = settle(step.join(onward.hint("merge"), "form", "left").select("word", F.coalesce("further", "form").alias("form"), "further"))
        if step.where(F.col("further").isNotNull()).isEmpty():
            return step.select("word", F.col("form").alias("root"))
        step = step.drop("further")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs`` (doc_id, text)."""
    counted = settle(word_counts(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    near = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    # Words grow with the corpus, so no join sends them through the driver, however small their files are.
    joined = counted.join(near.hint("merge"), "word", "left")
    is_form = -F.col("best.n") >= TIMES * F.col("n")
    found = settle(
        joined.select(
            "word",
            F.when(is_form, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
