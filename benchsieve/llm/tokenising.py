"""Token ids of whole texts, encoding each different word once per worker process.

The tokenizer drops white space and never joins characters across it, so a text's ids are
those of its words in turn. A final full stop or comma behind an ASCII letter or digit is a
token of its own as well. Words of letters only are encoded many at a time and told apart by
the mark that ends a word; all others are encoded one by one.
"""

from __future__ import annotations

import os
import sys
import types

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from benchsieve.llm import words

#: Words that a worker remembers, some 30 bytes each; further ones are encoded each time.
REMEMBERED_WORDS = 3_000_000
_AT_ONCE = 4000


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one behind another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """A tokenizer file with the ids of the words it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """The encoder that this worker process keeps between its tasks."""
        held = sys.modules.setdefault("_encoders", types.ModuleType("_encoders"))
        if path not in held.__dict__:
            held.__dict__[path] = cls(path)
        return held.__dict__[path]

    def _one_by_one(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for at in range(0, len(items), _AT_ONCE):
            part = items[at : at + _AT_ONCE]
            ids += [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.array([i for run in ids for i in run], np.int32), sizes

    def _letters(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, sizes = [], []
        for at in range(0, len(items), _AT_ONCE):
            part = items[at : at + _AT_ONCE]
            ids = self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids
            ids = np.array(ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                flats.append(ids)
                sizes.append(np.diff(last, prepend=-1).astype(np.int32))
            else:  # a letter that normalisation takes apart
                flat, size = self._one_by_one(part)
                flats.append(flat)
                sizes.append(size)
        empty = np.zeros(0, np.int32)
        return np.concatenate([empty, *flats]), np.concatenate([empty, *sizes])

    def lookup(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, sizes) of different words."""
        names = items.to_pylist()
        keys = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in names), np.uint64, len(names))
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        known = np.zeros(len(keys), bool)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if known.all():
            return self.flat, self.starts[at], self.sizes[at].astype(np.int64)
        letters = pc.utf8_is_alpha(items).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(~known & letters), np.flatnonzero(~known & ~letters)
        flat_a, sizes_a = self._letters([names[i] for i in plain])
        flat_b, sizes_b = self._one_by_one([names[i] for i in other])
        sizes = np.concatenate([sizes_a, sizes_b])
        starts = len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes
        merged = np.concatenate([self.keys, keys[plain], keys[other]])
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        all_starts = np.concatenate([self.starts, starts])[order]
        all_sizes = np.concatenate([self.sizes, sizes])[order]
        flat = np.concatenate([self.flat, flat_a, flat_b])
        if len(merged) <= REMEMBERED_WORDS:
            self.keys, self.starts, self.sizes, self.flat = merged, all_starts, all_sizes, flat
        at = np.searchsorted(merged, keys)
        return flat, all_starts[at], all_sizes[at].astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts one behind another, and where each begins."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        tokens = words.Tokens(texts if special else pc.ascii_lower(texts))
        if not len(tokens.distinct):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        core = pc.ascii_rtrim(tokens.distinct, ".,")
        plain = pc.match_substring_regex(core, "[A-Za-z0-9]$")
        core = pc.if_else(plain, core, tokens.distinct)
        # What the core leaves of a word: its final run of stops and commas, or nothing.
        tail = pc.replace_substring_regex(tokens.distinct, r"^.*?([.,]*)$", r"\1")
        tail = pc.if_else(plain, tail, "")
        units = pa.concat_arrays([core, tail]).dictionary_encode()
        flat, starts, sizes = self.lookup(units.dictionary)
        place = units.indices.to_numpy().reshape(2, -1).T.ravel()
        flat = gather(flat, starts[place], sizes[place])
        sizes = sizes[place].reshape(-1, 2).sum(1)
        starts = np.cumsum(sizes) - sizes
        ids = gather(flat, starts[tokens.codes], sizes[tokens.codes])
        ends = np.concatenate([[0], np.cumsum(sizes[tokens.codes])])
        return ids, ends[tokens.bounds]


@dataclass
class Pieces:
    """Documents' ids, cut: ``ids`` of all, and row, number, start and length of each piece."""

    ids: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    first: np.ndarray
    length: np.ndarray


def cut_documents(encoder: Encoder, texts: pa.Array, capacity: int, end_id: int) -> Pieces:
    """Encode texts, end each with ``end_id``, and cut what is longer than ``capacity``."""
    ids, bounds = encoder.encode(texts)
    ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
    bounds = bounds + np.arange(len(bounds))
    lengths = np.diff(bounds)
    counts = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * capacity
    length = np.minimum(lengths[row] - start, capacity)
    return Pieces(ids, row, piece, start, bounds[row] + start, length)
