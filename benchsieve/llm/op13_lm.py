"""Log probabilities of whole texts under a causal self-attention model, and a word unigram.

A text's words are its runs of characters other than ASCII white space, A-Z lower-cased. Each
word with a space in front is encoded by a byte-level tokenizer, and one end token follows; so
different word sequences have different ids and the probabilities of all texts sum to at most
one. ``attention`` has the model, ``score`` its log10 probability of those ids.

Everything counted is counted over all training texts: words for the unigram, ids for their
ranks, successive ids for the model's prior. The attention learns from every window of all
training texts. It starts with a task that learns on about ``FIRST_WINDOWS`` windows, drawn alike
from all texts. From there each task learns from all windows of its slices, one after the other,
in ``ROUNDS`` rounds, each with the slices of a hash; after a round the tasks' parameters are
averaged, weighted by windows.

Texts are tokenised once, into slices of about ``SLICE_BYTES`` of text. A slice keeps the hashes
of its distinct words; hashes are cut into buckets by range, summed there, and each slice gets
its sums back. So no table of all words goes to a task or the driver. Words are told apart by
64 bits. Ranks, prior and parameters have fixed sizes and go to every task.

Null and empty texts are the end token alone. Texts are read whole. Rows with null or repeated
keys are scored like others. Without training texts all counts are zero. Empty tables give an
empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import math
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import new_folder
from benchsieve.llm import attention, words
from benchsieve.llm.tokenising import gather

SLICE_BYTES = 3 << 19
#: The tokenizer's ids, and the end token, which it leaves free.
END_ID = 50_256
IDS = END_ID + 1
#: Entries of slices that one bucket sums.
BUCKET_ENTRIES = 1_000_000
FIRST_WINDOWS, FIRST_PASSES, FIRST_RATE = 16_384, 3, 0.01
ROUNDS, RATE, AT_ONCE = 2, 0.0025, 256
#: Words that a worker remembers; further ones are encoded each time.
REMEMBERED_WORDS = 2_000_000
#: Rows of slices are large; readers and writers hold so many bytes of them.
ROW_GROUP_BYTES = 8 << 20
_PARTS = 64

_SLICES = """slice long, keys array<long>, held array<boolean>, word_ends array<int>, codes binary,
    hashes binary, counts binary, n_words long, n_train long, id_ends array<int>, ids binary, n_windows long"""


class ByteEncoder:
    """A file of ranked byte sequences, with the ids of the words that a worker has seen."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranked = dict(line.split() for line in file)
        ranked = {base64.b64decode(word): int(n) for word, n in ranked.items()}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranked, special_tokens={})
        self.opens = np.zeros(IDS, bool)
        self.opens[[n for word, n in ranked.items() if word[:1] == b" "]] = True
        none = np.zeros(0, np.int64)
        self.keys, self.starts, self.sizes = none.astype(np.uint64), none, none
        self.flat = np.zeros(0, np.uint16)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def of_process(cls, path: str, pattern: str) -> ByteEncoder:
        held = sys.modules.setdefault("_encoders", types.ModuleType("_encoders"))
        if (path, pattern) not in held.__dict__:
            held.__dict__[path, pattern] = cls(path, pattern)
        return held.__dict__[path, pattern]

    def encode(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) of words, each with a space in front."""
        if not items:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(items)), np.uint16)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(items) and starts[0] == 0:
            return ids, np.diff(np.append(starts, len(ids)))
        # Some word has white space beyond ASCII, which the pattern would join to the next word.
        each = [self.encoding.encode_ordinary(f" {item}") for item in items]
        return np.array([i for e in each for i in e], np.uint16), np.array([len(e) for e in each])

    def look_up(self, keys: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, sizes) of words by their ascending hashes."""
        starts, sizes = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for held_keys, held_starts, held_sizes in [(self.keys, self.starts, self.sizes), *self.fresh]:
            at = np.minimum(np.searchsorted(held_keys, keys), max(len(held_keys) - 1, 0))
            if len(held_keys):
                found = held_keys[at] == keys
                starts[found], sizes[found] = held_starts[at[found]], held_sizes[at[found]]
        new = np.flatnonzero(sizes < 0)
        flat, new_sizes = self.encode([names[i] for i in new])
        starts[new] = len(self.flat) + np.cumsum(new_sizes) - new_sizes
        sizes[new] = new_sizes
        flat = np.concatenate([self.flat, flat])
        if len(self.keys) + sum(len(k) for k, *_ in self.fresh) + len(new) <= REMEMBERED_WORDS:
            self.flat = flat
            self.fresh.append((keys[new], starts[new], sizes[new]))
            if len(self.fresh) > 8:
                parts = [(self.keys, self.starts, self.sizes), *self.fresh]
                merged = [np.concatenate(column) for column in zip(*parts, strict=True)]
                order = np.argsort(merged[0])
                self.keys, self.starts, self.sizes = (column[order] for column in merged)
                self.fresh = []
        return flat, starts, sizes


def _stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder in small row groups, and read from there."""
    path = new_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as all first bytes, all second bytes and so on; the zeros of small ones shrink."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(value: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(width, len(value) // width).T).view(kind).ravel()


def _slices(path: str, pattern: str):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = ByteEncoder.of_process(path, pattern), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in words.slices(batch, most=SLICE_BYTES):
                tokens = words.Tokens(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
                # As an array first: to_pylist makes an object of Arrow of each word.
                names = tokens.distinct.to_numpy(zero_copy_only=False).tolist()
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
                order = np.argsort(keys)
                place = np.empty(len(keys), np.int64)
                place[order] = np.arange(len(keys))
                codes, keys = place[tokens.codes], keys[order]
                counts = np.bincount(codes[np.repeat(~held, tokens.sizes)], minlength=len(keys))
                flat, starts, sizes = encoder.look_up(keys, [names[i] for i in order])
                ids = gather(flat, starts[codes], sizes[codes])
                ends = np.concatenate([[0], np.cumsum(sizes[codes])])[tokens.bounds]
                ids = np.insert(ids, ends[1:], END_ID)
                ends = ends + np.arange(len(ends))
                small = len(keys) <= 1 << 16
                row = {
                    "slice": number,
                    "keys": part.column("doc_id").to_pylist(),
                    "held": held.tolist(),
                    "word_ends": tokens.bounds.tolist(),
                    "codes": codes.astype(np.uint16 if small else np.uint32).tobytes(),
                    "hashes": keys.tobytes(),
                    "counts": _planes(counts.astype(np.uint32)),
                    "n_words": len(keys),
                    "n_train": int((tokens.sizes + 1)[~held].sum()),
                    "id_ends": ends.tolist(),
                    "ids": ids.astype(np.uint16).tobytes(),
                    "n_windows": int((-(-np.diff(ends) // attention.STRIDE))[~held].sum()),
                }
                number += 1
                yield pa.RecordBatch.from_pylist([row], _SLICE_TYPES)

    return tokenise


_SLICE_TYPES = pa.schema(
    [
        ("slice", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("word_ends", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("hashes", pa.binary()),
        ("counts", pa.binary()),
        ("n_words", pa.int64()),
        ("n_train", pa.int64()),
        ("id_ends", pa.list_(pa.int32())),
        ("ids", pa.binary()),
        ("n_windows", pa.int64()),
    ]
)


def _cut(buckets: int):
    """Rows (bucket, slice, hashes, counts) of slices; buckets are ranges of hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = _numbers(r["hashes"], np.uint64), _from_planes(r["counts"], np.uint32)
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                found, first = np.unique(bucket, return_index=True)
                spans = [(int(a), int(b)) for a, b in zip(first, np.append(first, len(keys))[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(found.astype(np.int64)),
                        "slice": pa.array([r["slice"]] * len(found), pa.int64()),
                        "hashes": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                        "counts": pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary()),
                    }
                )

    return cut


def _summed(group: pa.Table) -> pa.Table:
    """Each slice's part of a bucket with the sums over all slices; the first row has the words known."""
    keys = [_numbers(v, np.uint64) for v in group["hashes"].to_pylist()]
    counts = np.concatenate([_from_planes(v, np.uint32) for v in group["counts"].to_pylist()])
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, counts, len(found)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    parts = [_planes(p) for p in np.split(sums[place], ends)]
    known = [int((sums > 0).sum())] + [0] * (len(parts) - 1)
    return pa.table(
        {"bucket": group["bucket"], "slice": group["slice"], "sums": pa.array(parts, pa.binary()), "known": known}
    )


def _base(n: int, distinct: int, ends: int):
    """Unigram scores of slices joined with their ``sums``, bucket by bucket."""
    scale = n + 0.5 * (distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_score = math.log10((ends + 0.5) / scale)
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.concatenate([_from_planes(v["sums"], np.int64) for v in r["sums"] or []] or [np.zeros(0)])
                codes = _numbers(r["codes"], np.uint16 if len(sums) <= 1 << 16 else np.uint32)
                bounds = np.array(r["word_ends"], np.int64)
                logs = np.log10((sums + 0.5) / scale)
                known = words.row_sums((sums > 0)[codes], bounds).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "slice": pa.array([r["slice"]] * len(r["keys"]), pa.int64()),
                        "row": pa.array(np.arange(len(r["keys"]), dtype=np.int32)),
                        "doc_id": pa.array(r["keys"], pa.int64()),
                        "held_out": pa.array(r["held"], pa.bool_()),
                        "n_tokens": pa.array(np.diff(bounds) + 1),
                        "n_known": pa.array(known),
                        "base_score": pa.array(words.row_sums(logs[codes], bounds) + end_score),
                    }
                )

    return score


def base_scores(slices: DataFrame) -> DataFrame:
    """(slice, row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    ends = F.sum(F.size(F.filter("held", lambda h: ~h)))
    n, entries, texts = slices.agg(F.sum("n_train"), F.sum("n_words"), ends).first()
    n, entries, texts = n or 0, entries or 0, texts or 0
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    cut = slices.select("slice", "hashes", "counts").mapInArrow(
        _cut(buckets), "bucket long, slice long, hashes binary, counts binary"
    )
    schema = "bucket long, slice long, sums binary, known long"
    summed = _stored(cut.groupBy("bucket").applyInArrow(_summed, schema))
    distinct = (summed.agg(F.sum("known")).first()[0] or 0) + (texts > 0)
    # A slice's sums are as many as its distinct words, whatever the number of buckets.
    sums = summed.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("bucket", "sums"))).alias("sums"))
    rows = slices.select("slice", "keys", "held", "word_ends", "codes").join(sums, "slice", "left")
    schema = "slice long, row int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
    found = rows.mapInArrow(_base(n, distinct, texts), schema)
    return found.withColumn("train_tokens", F.lit(n).cast("long"))


def _training(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, ids, bounds) of the training texts of each slice."""
    for r in batch.to_pylist():
        ids, bounds = _numbers(r["ids"], np.uint16), np.array(r["id_ends"], np.int64)
        kept, sizes = ~np.array(r["held"], bool), np.diff(bounds)
        yield r["slice"], ids[np.repeat(kept, sizes)], np.concatenate([[0], np.cumsum(sizes[kept])])


def id_counts(slices: DataFrame) -> np.ndarray:
    """How often each id, ``IDS`` of them, stands in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(IDS, np.int64)
        for batch in batches:
            for _, ids, _ in _training(batch):
                sums += np.bincount(ids, minlength=IDS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(sums[used])})

    rows = slices.select("slice", "held", "id_ends", "ids").mapInArrow(count, "id long, n long")
    out = np.zeros(IDS, np.int64)
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most IDS rows
        out[r["id"]] = r["n"]
    return out


def pair_counts(slices: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """(KNOWN + 2, KNOWN + 1) counts of successive tokens; a fixed size, so the driver holds them."""
    shape = attention.KNOWN + 2, attention.KNOWN + 1
    cells = shape[0] * shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            for _, ids, bounds in _training(batch):
                rank = np.minimum(ranks[ids], attention.KNOWN)
                last = np.concatenate([[attention.BEGIN], rank])[:-1]
                last[bounds[:-1][np.diff(bounds) > 0]] = attention.BEGIN
                sums += np.bincount(last * shape[1] + rank, minlength=cells)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used), "n": pa.array(sums[used])})

    rows = slices.select("slice", "held", "id_ends", "ids").mapInArrow(count, "cell long, n long")
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(shape)


def _drawn(number: int, count: int) -> np.ndarray:
    """A draw from 0 to 1 for each of a slice's windows, the same whenever it is made."""
    return np.random.default_rng([number & 0xFFFFFFFF, number >> 32]).random(count)


def _packed(p: attention.Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpacked(flat: np.ndarray, like: attention.Parameters) -> attention.Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_WINDOWS = "seen binary, hidden binary, target binary"


def _first_windows(slices: DataFrame, ranks: np.ndarray, share: float) -> DataFrame:
    """Rows of packed training windows to start with, one row a slice."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, bounds in _training(batch):
                w, _ = attention.windows(ranks[ids], bounds)
                w = w.take(_drawn(number, len(w.target)) < share)
                if len(w.target):
                    columns = [pa.array([v.tobytes()], pa.binary()) for v in (w.seen, w.hidden, w.target)]
                    yield pa.RecordBatch.from_arrays(columns, ["seen", "hidden", "target"])

    return slices.select("slice", "held", "id_ends", "ids").mapInArrow(choose, _WINDOWS)


_LEARNED = "part long, values binary, weight long"


def _learned(p: attention.Parameters, n: int) -> pa.RecordBatch:
    """A task's parameters, weighted by its windows, in ``_PARTS`` rows."""
    parts = [v.tobytes() for v in np.array_split(_packed(p).astype(np.float64) * n, _PARTS)]
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(np.arange(_PARTS)),
            "values": pa.array(parts, pa.binary()),
            "weight": pa.array([n] * _PARTS, pa.int64()),
        }
    )


def _started(p: attention.Parameters, before: attention.Parameters):
    """Learn from all windows given to a task, in several passes."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        w = attention.Windows(
            np.concatenate([_numbers(r["seen"], np.int32) for r in held]).reshape(-1, attention.WINDOW),
            np.concatenate([_numbers(r["hidden"], bool) for r in held]).reshape(-1, attention.WINDOW),
            np.concatenate([_numbers(r["target"], np.int32) for r in held]).reshape(-1, attention.STRIDE),
        )
        yield _learned(attention.train(p, before, w, FIRST_RATE, FIRST_PASSES, 0), len(w.target))

    return learn


def taught(
    slices: DataFrame, ranks: np.ndarray, p: attention.Parameters, before: attention.Parameters, turn: int
) -> DataFrame:
    """What each task learns from all training windows of its slices that a round has."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = attention.Trainer(p, before, RATE, AT_ONCE), 0
        for batch in batches:
            for number, ids, bounds in _training(batch):
                w, _ = attention.windows(ranks[ids], bounds)
                trainer.learn(w, 1, [number & 0xFFFFFFFF, number >> 32])
                n += len(w.target)
            words.release_memory()
        if n:
            yield _learned(trainer.p, n)

    mine = slices.where(F.pmod(F.xxhash64("slice"), F.lit(ROUNDS)) == turn)
    return mine.select("slice", "held", "id_ends", "ids").mapInArrow(learn, _LEARNED)


def _added(group: pa.Table) -> pa.Table:
    values = sum(_numbers(v, np.float64) for v in group["values"].to_pylist())
    weight = pc.sum(group["weight"])
    return pa.table({"part": group["part"][:1], "values": pa.array([values.tobytes()], pa.binary()), "weight": [weight.as_py()]})


def averaged(rows: DataFrame, like: attention.Parameters) -> attention.Parameters:
    """The weighted mean of the tasks' parameters: first of some 256 tasks, then of those."""
    schema = "part long, values binary, weight long"
    some = rows.withColumn("some", F.spark_partition_id() % 256)
    some = some.groupBy("part", "some").applyInArrow(lambda t: _added(t.drop_columns("some")), schema)
    found = some.groupBy("part").applyInArrow(_added, schema).collect()
    if not found:
        return like
    found.sort(key=lambda r: r["part"])
    return _unpacked(np.concatenate([_numbers(r["values"], np.float64) / r["weight"] for r in found]), like)


@dataclass
class ScoringModel:
    """``ranks`` of ids by frequency, log shares ``rare`` of those beyond the known ones, and the rest."""

    ranks: np.ndarray
    rare: np.ndarray
    before: attention.Parameters
    parameters: attention.Parameters


def learn(slices: DataFrame) -> ScoringModel:
    """The model of the training texts of settled ``slices``."""
    counts = id_counts(slices)
    order = np.argsort(-counts, kind="stable")
    ranks = np.empty(IDS, np.int64)
    ranks[order] = np.arange(IDS)
    rare = counts + 0.5
    rare[order[: attention.KNOWN]] = 0
    rare = np.where(rare > 0, np.log(np.maximum(rare, 0.5) / rare.sum()), 0)
    before = attention.prior(pair_counts(slices, ranks))

    p = attention.initial()
    total = slices.agg(F.sum("n_windows")).first()[0] or 0
    first = _first_windows(slices, ranks, FIRST_WINDOWS / max(total, FIRST_WINDOWS)).repartition(1)
    p = averaged(first.mapInArrow(_started(p, before), _LEARNED), p)
    for turn in range(ROUNDS):
        p = averaged(taught(slices, ranks, p, before, turn), p)
    return ScoringModel(ranks, rare, before, p)


def model_scores(slices: DataFrame, model: ScoringModel) -> DataFrame:
    """(slice, row, score) of all texts: log10 of their probability."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = attention.Tables(model.parameters)
        for batch in batches:
            for r in batch.to_pylist():
                ids, bounds = _numbers(r["ids"], np.uint16), np.array(r["id_ends"], np.int64)
                ranks = model.ranks[ids]
                w, text = attention.windows(ranks, bounds)
                sums = np.zeros(len(text))
                for start in range(0, len(text), attention.BATCH):
                    part = slice(start, start + attention.BATCH)
                    found = attention.log_probabilities(model.parameters, model.before, tables, w.take(part))
                    sums[part] = found.sum(1, dtype=np.float64)
                # A rare id's share of the rare class.
                shares = np.where(ranks >= attention.KNOWN, model.rare[ids], 0)
                total = np.bincount(text, sums, len(bounds) - 1) + words.row_sums(shares, bounds)
                yield pa.RecordBatch.from_pydict(
                    {
                        "slice": pa.array([r["slice"]] * len(total), pa.int64()),
                        "row": pa.array(np.arange(len(total), dtype=np.int32)),
                        "score": pa.array(total / math.log(10)),
                    }
                )
            words.release_memory()

    return slices.select("slice", "id_ends", "ids").mapInArrow(score, "slice long, row int, score double")


def tokenised(docs: DataFrame, held: Column, path: str, pattern: str) -> DataFrame:
    """Settled slices of ``docs`` (doc_id, text); texts where ``held`` is true teach nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    return _stored(rows.mapInArrow(_slices(path, pattern), _SLICES))


def score_texts(docs: DataFrame, held: Column, path: str, pattern: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    slices = tokenised(docs, held, path, pattern)
    base = base_scores(slices)
    return base.join(model_scores(slices, learn(slices)), ["slice", "row"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
