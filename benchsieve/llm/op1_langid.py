"""Language of whole texts by words first and character n-grams behind them.

A word (a run of letters, lower-cased) that was learned scores each language by the log of
its frequency there. An unseen word falls back to the longest of its character n-grams, five
to one, of which at least one was learned, and scores the mean of those.

Learning takes at most ``LABELLED_ROWS`` labelled rows, chosen by a hash of their key; this
is the bound of the sample and so of the model, which goes to every task.

A null text, or one without letters, is ``und`` with score 0, and so is every text when
there are no labelled rows. Equal scores go to the first language by code point. Rows with
null or repeated keys are scored like all others. Very long texts are read whole. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import words

LABELLED_ROWS = 20_000
LONGEST_GRAM = 5
#: Words and n-grams seen less often are left to shorter n-grams.
LEAST_COUNT = 3
#: A text counts as so many average words of evidence at most, which keeps scores below 1.
EVIDENCE_WORDS = 12
SMOOTHING = 0.5

_LETTERS = regex.compile(r"\p{L}+")


def word_keys(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in items), np.uint64, len(items))


def gram_keys(items: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the character n-grams of words with a space on either side, and their words."""
    text = np.frombuffer("".join(f" {w} " for w in items).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in items), np.int64, len(items))
    owner = np.repeat(np.arange(len(items)), lengths)
    if len(text) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.full(len(text) - n + 1, n, np.uint64)
    for i in range(n):
        keys = (keys ^ text[i : i + len(keys)]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    inside = owner[: len(keys)] == owner[n - 1 :]
    return keys[inside], owner[: len(keys)][inside]


def letter_words(values: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct letter runs of tokens, and for each run its token and its place in the list."""
    places: dict[str, int] = {}
    owners, runs = [], []
    for token, value in enumerate(values):
        for run in _LETTERS.findall(value.lower()):
            owners.append(token)
            runs.append(places.setdefault(run, len(places)))
    return list(places), np.array(owners, np.int64), np.array(runs, np.int64)


@dataclass(frozen=True)
class Table:
    """Sorted keys with a row of log probabilities by language."""

    keys: np.ndarray
    scores: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _table(keys: np.ndarray, counts: np.ndarray) -> Table:
    """Log probabilities of ``keys`` from ``counts`` (key, language)."""
    order = np.argsort(keys)
    totals = counts.sum(0) + SMOOTHING * max(1, len(keys))
    scores = np.log((counts + SMOOTHING) / totals)
    if len(keys):
        scores -= np.logaddexp.reduce(scores, axis=1)[:, None]
    return Table(keys[order], scores[order].astype(np.float32))


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    known: Table
    grams: dict[int, Table]

    def word_scores(self, items: list[str]) -> np.ndarray:
        """Log likelihood of each language for each word; zeros where nothing is known."""
        out = np.zeros((len(items), len(self.langs)), np.float32)
        found = self.known.find(word_keys(items))
        out[found >= 0] = self.known.scores[found[found >= 0]]
        left = np.flatnonzero(found < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            keys, owner = gram_keys([items[i] for i in left], n)
            at = self.grams[n].find(keys)
            owner, at = owner[at >= 0], at[at >= 0]
            hits = np.bincount(owner, minlength=len(left))
            done = hits > 0
            for k in range(len(self.langs)):
                total = np.bincount(owner, self.grams[n].scores[at, k], len(left))
                out[left[done], k] = total[done] / hits[done]
            left = left[~done]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        tokens = words.Tokens(texts)
        items, owners, runs = letter_words(tokens.values)
        per_word = self.word_scores(items)
        per_token = np.bincount(owners, minlength=len(tokens.values))
        n = words.row_sums(per_token[tokens.codes], tokens.bounds)
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n))
        logs = np.empty((len(n), len(self.langs)))
        for k in range(len(self.langs)):
            token_scores = np.bincount(owners, per_word[runs, k], len(tokens.values))
            logs[:, k] = words.row_sums(token_scores[tokens.codes], tokens.bounds)
        logs *= (np.minimum(n, EVIDENCE_WORDS) / np.maximum(n, 1))[:, None]
        best = logs.argmax(1)
        share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        names = [self.langs[b] if found else "und" for b, found in zip(best, n > 0, strict=True)]
        return names, np.where(n > 0, share, 0.0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            tokens = words.Tokens(part.column("text"))
            items, owners, runs = letter_words(tokens.values)
            langs, label = np.unique(
                np.array(part.column("label").to_pylist(), dtype=object).astype(str),
                return_inverse=True,
            )
            label_of = np.repeat(label, tokens.sizes)
            for k, lang in enumerate(langs):
                counts = np.bincount(tokens.codes[label_of == k], minlength=len(tokens.values))
                by_word = np.bincount(runs, counts[owners], len(items)).astype(np.int64)
                for place in np.array_split(np.flatnonzero(by_word), 1 + len(items) // 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([str(lang)] * len(place), pa.string()),
                            pa.array([items[i] for i in place], pa.string()),
                            pa.array(by_word[place]),
                        ],
                        ["label", "word", "n"],
                    )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.array(batch.column("label").to_pylist(), dtype=object).astype(str)
        counts = batch.column("n").to_numpy()
        items = batch.column("word").to_pylist()
        for lang in np.unique(label):
            own = np.flatnonzero(label == lang)
            for n in range(1, LONGEST_GRAM + 1):
                keys, owner = gram_keys([items[i] for i in own], n)
                keys, inverse = np.unique(keys, return_inverse=True)
                total = np.bincount(inverse, counts[own][owner], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([str(lang)] * len(keys), pa.string()),
                        pa.array(np.full(len(keys), n, np.int32)),
                        pa.array(keys.view(np.int64)),
                        pa.array(total),
                    ],
                    ["label", "size", "key", "n"],
                )


def bounded_sample(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows chosen by a hash of ``key``; all rows when there are fewer."""
    share = min(1.0, most / max(1, labelled.count()))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    return labelled.where(place < int(share * (1 << 30))) if share < 1 else labelled


def learn(labelled: DataFrame, most_rows: int = LABELLED_ROWS) -> LanguageModel:
    """Fit on ``labelled`` (doc_id, text, label); rows without text or label do not count."""
    rows = labelled.select("doc_id", "text", F.col("label").cast("string").alias("label"))
    rows = bounded_sample(rows.where(F.col("label").isNotNull()), "doc_id", most_rows)
    counted = settle(
        rows.where(F.col("text").isNotNull())
        .select("text", "label")
        .mapInArrow(_count_words, "label string, word string, n long")
        .groupBy("label", "word")
        .agg(F.sum("n").alias("n"))
    )
    langs = sorted(r[0] for r in counted.select("label").distinct().collect())

    def gathered(table: DataFrame, key: str) -> tuple[pa.ChunkedArray, np.ndarray]:
        by_lang = [
            F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"c{i}")
            for i, x in enumerate(langs)
        ]
        found = table.groupBy(key).agg(F.sum("n").alias("n"), *by_lang)
        rows = found.where(F.col("n") >= LEAST_COUNT).drop("n").toArrow()
        counts = [rows.column(i).to_numpy() for i in range(1, len(langs) + 1)]
        shape = (rows.num_rows, len(langs))
        return rows.column(0), np.array(counts, np.float64).reshape(shape[::-1]).T

    known, counts = gathered(counted, "word")
    known = _table(word_keys(known.to_pylist()), counts)
    pairs = settle(
        counted.mapInArrow(_count_grams, "label string, size int, key long, n long")
        .groupBy("label", "size", "key")
        .agg(F.sum("n").alias("n"))
    )
    grams = {}
    for n in range(1, LONGEST_GRAM + 1):
        keys, counts = gathered(pairs.where(F.col("size") == n), "key")
        grams[n] = _table(keys.to_numpy().view(np.uint64), counts)
    return LanguageModel(langs, known, grams)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                names, scores = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(read, schema)


def held_out(key: str | Column = "doc_id") -> Column:
    """The fold that no operator learns from; rows without key belong to none."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: LanguageModel, least_score: float) -> DataFrame:
    """The rows of ``docs`` whose language is clear: not ``und`` and a score to the bound.

    All columns stay as they are. Each row is judged by itself, in place.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                names, scores = model.predict(part.column("text"))
                kept = (np.array(names) != "und") & (scores >= least_score)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(read, docs.schema)
