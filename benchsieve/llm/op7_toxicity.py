"""Toxicity of whole texts after undoing disguises of words.

Words may be disguised by digits and signs for letters, by letters set apart, and by repeated
letters. Such a word opens a lattice of the characters it may stand for; a Viterbi search
under a character trigram model, with costs for each disguise, restores the likeliest text,
whatever its length. Words wholly of digits and signs are restored too if each of them may stand
for a letter; of those only whole words count and no beginnings, so plain numbers stay clean.
The trigrams come from the words of all documents in all scripts, without marks at their edges
and cut at inner ones (letters set apart are no words), and so grow with the corpus up to the
number of different trigrams of letters, which the driver holds. Combining marks are left out.

Restored words are scored by log odds of the label, learned for words and their beginnings on
at most ``LABELLED_ROWS`` labelled rows chosen by a hash of their key (the bound of the
sample and of the model). The sum over a text's different words becomes a probability by a logistic fit.

Null and empty texts score like texts without any evidence. Rows with null or repeated keys
are scored like all others; labels of a repeated key must not differ, or the highest counts.
An empty table gives an empty result; without labelled rows every score is 0. Very long
texts are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.llm import words
from benchsieve.llm.op1_langid import bounded_sample

LABELLED_ROWS = 40_000
#: Letters that a digit or sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Log costs in the lattice: a sign for a letter, a dropped or kept separator, a shortened run.
SIGN_COST, SEPARATOR_COST, RUN_COST, PAIR_COST = -1.0, -0.5, -1.0, -4.0
SPLIT_COST, DROP_COST = -7.0, -9.0
BEGINNINGS = (3, 4, 5, 6)
#: Prior rows that hold log odds of rare words near zero, the least odds that count, and the
#: least log likelihood ratio, which chance hardly reaches among millions of features.
PRIOR_ROWS, LEAST_ODDS, LEAST_RATIO = 5.0, 2.5, 13.0
MOST_EVIDENCE = 30.0
#: Characters that a search holds for each state before it puts the common ones aside, and the
#: longest word whose answer is kept.
HELD, KEPT = 256, 100
#: Bits of a code point in a packed trigram.
POINT = 21

_EDGE = ".,;:?\"'()[]{}<>…*_-~`«»„“”‚‘’/\\#%&=^"
_INNER = re.compile(f"[{re.escape(_EDGE)}]+")
_RUN = re.compile(r"(.)\1*", re.S)
_THREE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1+")


def letter_words(token: str) -> list[str]:
    """The words of letters in a token, none if only letters set apart are in it."""
    core = token.strip(_EDGE).rstrip("!|")
    if core.isalpha():
        return [core]
    bare = "".join(c for c in core if c.isascii() or unicodedata.category(c)[0] != "M")
    found = [p for p in _INNER.split(bare) if p.isalpha()]
    return found if any(len(p) > 1 for p in found) else []


def trigram_counts(values: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of letters in words with edges, and their weighted counts."""
    kept = [(f"  {w} ", c) for v, c in zip(values, counts, strict=True) for w in letter_words(v)]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer("".join(v for v, _ in kept).encode("utf-32-le"), np.uint32)
    text = text.astype(np.int64)
    weight = np.repeat([c for _, c in kept], [len(v) for v, _ in kept])[2:]
    a, b, c = text[:-2], text[1:-1], text[2:]
    # A window over the edge of two words holds a space behind a letter and before another.
    inside = ~((b == 32) & (a != 32)) & ~((b == 32) & (c == 32))
    packed, place = np.unique((a << 2 * POINT | b << POINT | c)[inside], return_inverse=True)
    return packed, np.bincount(place, weight[inside], len(packed)).astype(np.int64)


@dataclass
class CharacterModel:
    """Interpolated character trigrams."""

    three: dict[str, float]
    two: dict[str, float]
    one: dict[str, float]

    @classmethod
    def from_counts(cls, rows: list[tuple[int, int]]) -> CharacterModel:
        tri: Counter = Counter()
        for packed, n in rows:
            tri["".join(chr(packed >> at & (1 << POINT) - 1) for at in (2 * POINT, POINT, 0))] += n
        pair, one, head, start = Counter(), Counter(), Counter(), Counter()
        for t, n in tri.items():
            pair[t[1:]] += n
            one[t[2]] += n
            head[t[:2]] += n
            start[t[1]] += n
        total = sum(one.values())
        return cls(
            {t: n / head[t[:2]] for t, n in tri.items()},
            {t: n / start[t[0]] for t, n in pair.items()},
            {t: n / total for t, n in one.items()},
        )

    def log(self, before: str, c: str) -> float:
        p = 0.75 * self.three.get(before + c, 0.0) + 0.2 * self.two.get(before[1] + c, 0.0)
        return math.log(p + 0.05 * self.one.get(c, 0.0) + 1e-6)


def lattice(text: str) -> Iterator[list[tuple[str, float]]]:
    """What each run of equal characters may stand for, with its log cost."""
    for run in _RUN.finditer(text):
        c, n = run.group(1), len(run.group())
        if c.isalpha():
            whole = [(c * min(n, 2), 0.0 if n < 3 else RUN_COST)]
            yield whole + [(c, RUN_COST if n > 2 else PAIR_COST)] * (n > 1)
        elif c in SIGNS:
            letters = [(x * m, SIGN_COST * m) for x in SIGNS[c] for m in range(1, min(n, 2) + 1)]
            yield [*letters, (" ", SPLIT_COST), ("", DROP_COST)]
        else:
            yield [("", SEPARATOR_COST), (" ", SEPARATOR_COST)]


def decode(steps: Iterable[list[tuple[str, float]]], model: CharacterModel) -> list[str]:
    """The likeliest words of a lattice (Viterbi over the last two characters).

    What all states agree on is put aside, so time and memory are linear in the length.
    """
    best = {"  ": (0.0, "")}
    done, bound = [], HELD
    for options in steps:
        after: dict[str, tuple[float, str]] = {}
        for state, (score, text) in best.items():
            for out, cost in options:
                s, total = state, score + cost
                if out == " " and s[1] == " ":
                    out = ""
                for c in out:
                    total += model.log(s, c)
                    s = "  " if c == " " else s[1] + c
                if s not in after or total > after[s][0]:
                    after[s] = (total, text + out)
        best = after
        if max(len(t) for _, t in best.values()) > bound:
            shared = os.path.commonprefix([t for _, t in best.values()])
            done.append(shared)
            best = {s: (score, t[len(shared) :]) for s, (score, t) in best.items()}
            bound = max(HELD, 2 * max(len(t) for _, t in best.values()))
    ends = ((s + (0.0 if k[1] == " " else model.log(k, " ")), t) for k, (s, t) in best.items())
    return ("".join(done) + max(ends)[1]).split()


def may_be_word(core: str) -> bool:
    """Whether a text without letters may stand for some: all its digits and some signs do."""
    return any(c in SIGNS for c in core) and all(c in SIGNS or not c.isalnum() for c in core)


@dataclass
class Restorer:
    """Restored words of tokens; answers are kept up to a bound."""

    model: CharacterModel
    seen: dict[str, list[str]] = field(default_factory=dict)

    def restore(self, token: str) -> list[str]:
        core = token.lower().strip(_EDGE).rstrip("!|")
        if core.isalpha() and not _THREE.search(core):
            return [core]
        if not any(map(str.isalpha, core)) and not may_be_word(core):
            return []
        return self.search(core)

    def search(self, core: str) -> list[str]:
        if len(core) > KEPT:
            return decode(lattice(core), self.model)
        if core not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[core] = decode(lattice(core), self.model)
        return self.seen[core]

    def spaced(self, letters: list[str]) -> list[str]:
        """Words of letters that stand apart."""
        steps: list[list[tuple[str, float]]] = []
        for letter in letters:
            steps += [[("", SEPARATOR_COST), (" ", SEPARATOR_COST)]] * bool(steps)
            steps += lattice(letter)
        return decode(steps, self.model)


def has_run(values: pa.Array, length: int) -> np.ndarray:
    """Whether a value holds so many equal ASCII letters in a row."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset :][: len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) < length:
        return np.zeros(len(values), bool)
    same = (data[1:] == data[:-1]) & (data[1:] >= 97) & (data[1:] <= 122)
    runs = same if length == 2 else same[1:] & same[:-1]
    # A run must end where its value does.
    starts = offsets - offsets[0]
    value = np.searchsorted(starts, np.flatnonzero(runs), "right") - 1
    inside = np.flatnonzero(runs) + length <= starts[value + 1]
    out = np.zeros(len(values), bool)
    out[value[inside]] = True
    return out


def features(word: str) -> list[str]:
    return [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def token_features(token: str, restorer: Restorer) -> list[str]:
    """Features of a token's words; without letters, whole words only."""
    found = restorer.restore(token)
    if any(map(str.isalpha, token)):
        return [f for w in found for f in features(w)]
    return [f"w{w}" for w in found]


def _is_letter(token: str) -> bool:
    core = token.strip(_EDGE)
    return len(core) == 1 and (core.isalpha() or core in SIGNS)


def spaced_runs(tokens: words.Tokens) -> Iterator[tuple[int, list[str]]]:
    """(row, letters) of each run of three or more tokens of one letter."""
    single = np.fromiter((len(v) < 6 and _is_letter(v) for v in tokens.values), bool, len(tokens.values))
    at = np.flatnonzero(single[tokens.codes]) if len(tokens.codes) else np.zeros(0, np.int64)
    if not len(at):
        return
    rows = np.searchsorted(tokens.bounds, at, "right") - 1
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(rows) != 0)) + 1
    for run in np.split(np.arange(len(at)), breaks):
        if len(run) >= 3:
            yield (
                int(rows[run[0]]),
                [tokens.values[tokens.codes[at[i]]].lower().strip(_EDGE) for i in run],
            )


@dataclass
class ToxicityModel:
    characters: CharacterModel
    odds: dict[str, float]
    slope: float
    base: float

    def word_evidence(self, word: str, restorer: Restorer) -> float:
        best = max((self.odds.get(f, 0.0) for f in features(word)), default=0.0)
        if not best and _DOUBLE.search(word):
            found = restorer.search(word)
            best = max((self.odds.get(f"w{w}", 0.0) for w in found), default=0.0)
        return best

    def evidence(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        tokens = words.Tokens(texts)
        value = self.token_evidence(tokens.distinct, restorer)
        # A word counts once in a text.
        at = np.flatnonzero(value[tokens.codes]) if len(tokens.codes) else np.zeros(0, np.int64)
        row = np.searchsorted(tokens.bounds, at, "right") - 1
        row, code = np.divmod(np.unique(row * len(value) + tokens.codes[at]), max(1, len(value)))
        total = np.bincount(row, value[code], len(texts))
        for row, letters in spaced_runs(tokens):
            total[row] += sum(self.word_evidence(w, restorer) for w in restorer.spaced(letters))
        return np.minimum(total, MOST_EVIDENCE)

    def token_evidence(self, distinct: pa.Array, restorer: Restorer) -> np.ndarray:
        """Evidence of each token; undisguised words are looked up as one Arrow batch."""
        core = pc.utf8_trim(pc.utf8_lower(distinct), _EDGE)
        plain = pc.utf8_rtrim(core, "!|")
        clear = pc.utf8_is_alpha(plain).to_numpy(zero_copy_only=False) & ~has_run(plain, 3)
        best = np.zeros(len(distinct))
        for size, (names, odds) in self.by_size.items():
            part = plain if size == 0 else pc.utf8_slice_codeunits(plain, 0, size)
            at = pc.index_in(part, names)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            if size:
                found &= pc.greater(pc.utf8_length(plain), size).to_numpy(zero_copy_only=False)
            places = at.fill_null(0).to_numpy(zero_copy_only=False)
            best[found] = np.maximum(best[found], odds[places[found]])
        for i in np.flatnonzero(~clear | (best == 0) & self.shortens(plain)):
            token = distinct[int(i)].as_py()
            found = restorer.restore(token)
            if any(map(str.isalpha, token)):
                best[i] = sum(self.word_evidence(w, restorer) for w in found)
            else:
                best[i] = sum(self.odds.get(f"w{w}", 0.0) for w in found)
        return best

    def shortens(self, plain: pa.Array) -> np.ndarray:
        """Whether a word with doubled letters is a learned one when they are single."""
        whole = {_DOUBLE.sub(r"\1", f[1:]) for f in self.odds if f[0] == "w"}
        out = np.zeros(len(plain), bool)
        for i in np.flatnonzero(has_run(plain, 2)):
            out[i] = _DOUBLE.sub(r"\1", plain[int(i)].as_py()) in whole
        return out

    @cached_property
    def by_size(self) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """Features by the length of a beginning (0: whole words)."""
        out = {}
        for size in (0, *BEGINNINGS):
            mark = str(size) if size else "w"
            own = [(f[1:], v) for f, v in self.odds.items() if f[0] == mark]
            out[size] = pa.array([f for f, _ in own], pa.string()), np.array([v for _, v in own])
        return out

    def score(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * self.evidence(texts, restorer))))


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            tokens = words.Tokens(part.column("text"))
            counts = np.bincount(tokens.codes, minlength=len(tokens.values))
            packed, n = trigram_counts([v.lower() for v in tokens.values], counts)
            yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(n)], ["gram", "n"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least shingle hash, which copies and most near copies of a text share."""
    for batch in batches:
        for part in words.slices(batch):
            hashes, bounds = words.shingle_hashes(part.column("text"))
            least = words.Permutations(1, 0).signatures(hashes, bounds)[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("text"), part.column("label"), pa.array(least)],
                ["text", "label", "mark"],
            )


def character_model(docs: DataFrame) -> CharacterModel:
    """Trigrams of the words of all ``docs`` (text)."""
    grams = (
        docs.select("text")
        .mapInArrow(_count_trigrams, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
    )
    return CharacterModel.from_counts([(r["gram"], r["n"]) for r in grams.collect()])


def learn(
    labelled: DataFrame, characters: CharacterModel, most_rows: int = LABELLED_ROWS
) -> ToxicityModel:
    """Fit on ``labelled`` (doc_id, text, label), label 0 or 1; other rows do not count."""
    rows = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = bounded_sample(rows.where(F.col("label").isin(0, 1)), "doc_id", most_rows)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for batch in batches:
            for part in words.slices(batch):
                tokens = words.Tokens(part.column("text"))
                place: dict[str, int] = defaultdict(lambda: len(place))
                own = [
                    [place[f] for f in token_features(v, restorer)]
                    for v in tokens.values
                ]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                flat = np.array([f for fs in own for f in fs], np.int64)
                firsts = np.concatenate([[0], np.cumsum(sizes)])
                row = np.repeat(np.arange(part.num_rows), tokens.sizes)
                seen = np.unique(row * max(1, len(own)) + tokens.codes)
                row, code = np.divmod(seen, max(1, len(own)))
                repeat = sizes[code]
                spread = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                feature = flat[np.repeat(firsts[code], repeat) + spread]
                seen = np.unique(np.repeat(row, repeat) * max(1, len(place)) + feature)
                row, feature = np.divmod(seen, max(1, len(place)))
                label = part.column("label").to_numpy()[row]
                names = list(place)
                yes = np.bincount(feature, label, len(names)).astype(np.int64)
                all_rows = np.bincount(feature, minlength=len(names))
                for at in range(0, len(names), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[at : at + 50_000], pa.string()),
                            pa.array(yes[at : at + 50_000]),
                            pa.array(all_rows[at : at + 50_000]),
                        ],
                        ["feature", "yes", "n"],
                    )

    rows = settle(
        rows.select("text", "label")
        .mapInArrow(_mark, "text string, label int, mark long")
        .groupBy("mark", "label")
        .agg(F.min("text").alias("text"))
        .select("text", "label")
    )
    n, yes = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not yes or yes == n:
        return ToxicityModel(characters, {}, 0.0, math.inf if n and yes == n else -math.inf)
    rate = yes / n
    odds = F.log(
        (F.col("yes") + PRIOR_ROWS * rate)
        / (F.col("n") - F.col("yes") + PRIOR_ROWS * (1 - rate))
        * ((1 - rate) / rate)
    )
    share = F.col("yes") / F.col("n")
    ratio = F.col("yes") * F.log(share / rate) + (F.col("n") - F.col("yes")) * F.coalesce(
        F.log((1 - share) / (1 - rate)), F.lit(0.0)
    )
    strong = (
        rows.mapInArrow(count, "feature string, yes long, n long")
        .groupBy("feature")
        .agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        .where((F.col("yes") > 0) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO))
        .select("feature", odds.alias("odds"))
    )
    model = ToxicityModel(
        characters, {r["feature"]: r["odds"] for r in strong.collect()}, 0.0, 0.0
    )
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for batch in batches:
            for part in words.slices(batch):
                value = model.evidence(part.column("text"), restorer)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.round(value * 4).astype(np.int64)), part.column("label")],
                    ["bin", "label"],
                )

    # At most 4 * MOST_EVIDENCE + 1 bins.
    bins = (
        rows.mapInArrow(weigh, "bin long, label int")
        .groupBy("bin")
        .agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([b["bin"] / 4 for b in bins])
    model.base, model.slope = logistic_fit(
        x, np.array([b["yes"] for b in bins]), np.array([b["n"] for b in bins])
    )
    return model


def logistic_fit(x: np.ndarray, yes: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through counts, with a weak pull of the slope."""
    design = np.stack([np.ones_like(x), x], 1)
    weights = np.zeros(2)
    pull = np.diag([1e-3, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (yes - n * p) - pull @ weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.characters)
        for batch in batches:
            for part in words.slices(batch):
                scores = model.score(part.column("text"), restorer)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores)], ["doc_id", "score"]
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", "text").mapInArrow(read, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, below: float) -> DataFrame:
    """The rows of ``docs`` that score below the bound, with all their columns."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.characters)
        for batch in batches:
            for part in words.slices(batch):
                yield part.filter(pa.array(model.score(part.column("text"), restorer) < below))

    return docs.mapInArrow(read, docs.schema)
