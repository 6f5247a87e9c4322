"""A small causal self-attention language model over ranks of subword ids, in numpy.

A position sees the tokens up to itself in its window. Its query, and the keys and values of
what it sees, are projections of embeddings; a bias for each distance is added to the scores.
What it attends to, and a prior for the token just seen, give the next token in two steps: a
class of ``CLASS_SIZE`` ranks, then the rank within the class. The prior is made of the corpus's
counts of successive tokens and stays as it is; all else is trained. Ranks beyond the last class
are one more class, whose ids the caller tells apart by their counts. Probabilities sum to one.

Windows overlap: a window's last ``STRIDE`` positions are scored, each once, and the
``CONTEXT`` positions before them are only seen. A document begins with a marker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

STRIDE, CONTEXT = 32, 16
WINDOW = CONTEXT + STRIDE
CLASSES, CLASS_SIZE = 32, 32
KNOWN = CLASSES * CLASS_SIZE
#: Input numbers of any rank beyond the known ones, and of the marker before a text.
RARE, BEGIN = KNOWN, KNOWN + 1
WIDTH, KEY_WIDTH, VALUE_WIDTH = 16, 8, 16
#: A token seen before counts as so many more of its successors, at their shares of all tokens.
PRIOR = 5
#: Windows that are worked on at once, and how many of them attend at once.
BATCH, PART = 512, 64
#: Targets whose logits are worked on at once.
ROWS = 2048

_HIDDEN = np.float32(-1e9)
_QUERY = np.arange(STRIDE)[:, None] + CONTEXT
_SEEN = np.arange(WINDOW)[None, :]
_DISTANCE = np.clip(_QUERY - _SEEN, 0, WINDOW - 1)
_CAUSAL = np.where(_SEEN <= _QUERY, np.float32(0), _HIDDEN).astype(np.float32)

Parameters = dict[str, np.ndarray]


def prior(pairs: np.ndarray) -> Parameters:
    """Logs of the shares of classes, and of ranks within them, after each input number.

    ``pairs`` (KNOWN + 2, KNOWN + 1) counts successive tokens by input number and rank, the last
    column being all ranks beyond the known ones.
    """
    alone = pairs.sum(0) + 0.5
    alone /= alone.sum()
    share = (pairs + PRIOR * alone) / (pairs.sum(1, keepdims=True) + PRIOR)
    ranks = share[:, :KNOWN].reshape(-1, CLASSES, CLASS_SIZE)
    classes = ranks.sum(2)
    return {
        "class": np.log(np.concatenate([classes, share[:, KNOWN:]], axis=1)).astype(np.float32),
        "rank": np.log(ranks / classes[:, :, None]).astype(np.float32),
    }


def initial(seed: int = 7) -> Parameters:
    """Small random weights."""
    draw = np.random.default_rng(seed)
    found = {
        "embed": draw.normal(0, 0.5, (KNOWN + 2, WIDTH)),
        "query": draw.normal(0, WIDTH**-0.5, (WIDTH, KEY_WIDTH)),
        "key": draw.normal(0, WIDTH**-0.5, (WIDTH, KEY_WIDTH)),
        "value": draw.normal(0, WIDTH**-0.5, (WIDTH, VALUE_WIDTH)),
        "near": np.zeros(WINDOW),
        "class": draw.normal(0, 0.02, (VALUE_WIDTH, CLASSES + 1)),
        "rank": draw.normal(0, 0.02, (CLASSES, VALUE_WIDTH, CLASS_SIZE)),
    }
    return {k: v.astype(np.float32) for k, v in found.items()}


@dataclass
class Windows:
    """``seen`` (n, WINDOW) input numbers, ``hidden`` of them, ``target`` (n, STRIDE) ranks or -1."""

    seen: np.ndarray
    hidden: np.ndarray
    target: np.ndarray

    def take(self, chosen) -> Windows:
        return Windows(self.seen[chosen], self.hidden[chosen], self.target[chosen])


def windows(ranks: np.ndarray, bounds: np.ndarray) -> tuple[Windows, np.ndarray]:
    """Windows over all texts, and the text of each; ``ranks`` end with each text's end token."""
    sizes = np.diff(bounds)
    counts = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), counts)
    ends = np.cumsum(counts)
    filled = np.flatnonzero(counts)
    first, last = (ends - counts)[filled], ends[filled] - 1
    # Each text's tokens fill its windows, the last one in part. A position sees the token before it,
    # the first one the marker.
    n = len(ranks)
    slots = np.arange(n) + np.repeat((ends - counts) * STRIDE - bounds[:-1], sizes)
    target = np.full((len(text), STRIDE), -1, np.int32)
    target.ravel()[slots] = ranks
    known = np.empty(n, np.int32)
    np.minimum(ranks[:-1], RARE, out=known[1:], casting="unsafe")
    known[bounds[:-1][filled]] = BEGIN
    scored = np.full((len(text), STRIDE), BEGIN, np.int32)
    scored.ravel()[slots] = known
    seen = np.empty((len(text), WINDOW), np.int32)
    seen[:, CONTEXT:] = scored
    seen[1:, :CONTEXT] = scored[:-1, STRIDE - CONTEXT :]
    seen[first, :CONTEXT] = BEGIN
    hidden = np.zeros((len(text), WINDOW), bool)
    hidden[first, :CONTEXT] = True
    hidden[last, CONTEXT:] |= target[last] < 0
    return Windows(seen, hidden, target), text


#: Columns of joined projections: keys, values, queries.
_KEYS, _VALUES = slice(0, KEY_WIDTH), slice(KEY_WIDTH, KEY_WIDTH + VALUE_WIDTH)
_QUERIES = slice(KEY_WIDTH + VALUE_WIDTH, 2 * KEY_WIDTH + VALUE_WIDTH)
_SCALE = np.float32(KEY_WIDTH**-0.5)
_ONES = np.ones((max(CLASSES + 1, CLASS_SIZE), 1), np.float32)
#: Scores and logits beyond this are cut, so that their exponents can be summed as they are.
_MOST = np.float32(60)
#: Bounds up to this need no cut, whatever their rounding.
_SAFE = np.float32(59)


def _turned(rows: np.ndarray) -> np.ndarray:
    """Each window's rows as columns, laid out anew, which small products are faster with."""
    return np.ascontiguousarray(rows.transpose(0, 2, 1))


def _exponents(logits: np.ndarray, cut: bool) -> np.ndarray:
    """Exponents of logits, those of large ones cut; overwrites ``logits``."""
    if cut:
        np.minimum(logits, _MOST, out=logits)
    return np.exp(logits, out=logits)


class Tables:
    """What every input number projects to, so that windows only look it up.

    A value has a one behind it, so that products with values also sum weights or subtract means.
    """

    def __init__(self, p: Parameters):
        self.into = np.concatenate([p["key"], p["value"], p["query"] * _SCALE], axis=1)
        found = p["embed"] @ self.into
        self.query = np.ascontiguousarray(found[:, _QUERIES])
        self.both = np.concatenate([found[:, : _VALUES.stop], np.ones((len(found), 1), np.float32)], axis=1)
        self.near = p["near"][_DISTANCE] + _CAUSAL
        # No score is beyond the sum of the largest products, no logit of a value beyond the product of the
        # largest norms; logits of the prior are not above 0.
        most, value = np.abs(found).max(0), found[:, _VALUES]
        self.cut_scores = most[_KEYS] @ most[_QUERIES] + p["near"].max() > _SAFE
        out = max(np.square(p["class"]).sum(0).max(), np.square(p["rank"]).sum(1).max())
        self.cut_logits = np.sqrt(np.einsum("ij,ij->i", value, value).max() * out) > _SAFE

    def look_up(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys, and values with their ones."""
        both = self.both.take(w.seen, axis=0)
        return self.query.take(w.seen[:, CONTEXT:], axis=0), both[:, :, _KEYS], both[:, :, KEY_WIDTH:]

    def weights(self, q: np.ndarray, k: np.ndarray, w: Windows) -> np.ndarray:
        """Exponents of the scores, not yet divided by their sums."""
        scores = np.matmul(q, _turned(k))
        scores += self.near
        # Behind a text's end nothing is scored, and nothing before it sees that.
        edge = np.flatnonzero(w.hidden[:, 0])
        if len(edge):
            scores[edge] += np.where(w.hidden[edge], _HIDDEN, np.float32(0))[:, None, :]
        return _exponents(scores, self.cut_scores)


def _parts(n: int) -> list[slice]:
    return [slice(start, min(start + PART, n)) for start in range(0, n, PART)]


def attend(t: Tables, w: Windows) -> np.ndarray:
    """(windows, STRIDE, VALUE_WIDTH + 1): what the scored positions attend to, not yet divided by
    the sums of weights behind it, part by part."""
    out = np.empty((len(w.seen), STRIDE, VALUE_WIDTH + 1), np.float32)
    for rows in _parts(len(out)):
        part = w.take(rows)
        q, k, v = t.look_up(part)
        np.matmul(t.weights(q, k, part), v, out=out[rows])
    return out


class Targets:
    """The targets of windows in the order of their classes, in parts that fit a processor's cache."""

    def __init__(self, p: Parameters, before: Parameters, t: Tables, w: Windows):
        self.p, self.before, self.cut = p, before, t.cut_logits
        self.ranks_before = before["rank"].reshape(-1, CLASS_SIZE)
        target = w.target.ravel()
        kept = np.flatnonzero(target >= 0)
        rank = target.take(kept)
        group = (np.minimum(rank, KNOWN) // CLASS_SIZE).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        self.kept, self.group, self.rank = kept.take(order), group.take(order), rank.take(order) % CLASS_SIZE
        self.last = w.seen[:, CONTEXT:].ravel().take(self.kept)
        self.ends = np.cumsum(np.bincount(group, minlength=CLASSES + 1)).tolist()

    def parts(self) -> Iterator[tuple[slice, int, list[tuple[int, slice, slice]]]]:
        """Rows, how many of them are of known classes, and each class with its rows, in all and in the part."""
        known = self.ends[-2]
        for start in range(0, len(self.kept), ROWS):
            end, runs = min(start + ROWS, len(self.kept)), []
            for c in range(int(self.group[start]), min(int(self.group[end - 1]) + 1, CLASSES)):
                a, b = max(start, self.ends[c - 1] if c else 0), min(end, self.ends[c])
                if b > a:
                    runs.append((c, slice(a, b), slice(a - start, b - start)))
            yield slice(start, end), max(0, min(end, known) - start), runs

    def class_logits(self, rows: slice, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of classes, and the flat places of the targets' ones."""
        logits = read[rows] @ self.p["class"]
        logits += self.before["class"].take(self.last[rows], axis=0)
        return logits, np.arange(0, logits.size, CLASSES + 1) + self.group[rows]

    def rank_logits(self, rows: slice, known: int, runs, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of ranks in the known classes of ``rows``, and the flat places of the targets' ones."""
        rows = slice(rows.start, rows.start + known)
        logits = np.empty((known, CLASS_SIZE), np.float32)
        for c, of, mine in runs:
            np.matmul(read[of], self.p["rank"][c], out=logits[mine])
        logits += self.ranks_before.take(self.last[rows] * CLASSES + self.group[rows], axis=0)
        return logits, np.arange(0, logits.size, CLASS_SIZE) + self.rank[rows]

    def logs(self, logits: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logs of the shares of the targets; overwrites ``logits``."""
        found = logits.ravel().take(places)
        if self.cut:
            np.minimum(found, _MOST, out=found)
        sums = _exponents(logits, self.cut) @ _ONES[: logits.shape[1]]
        found -= np.log(sums)[:, 0]
        return found

    def errors(self, logits: np.ndarray, places: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of negative logs of the shares of the targets, and all shares less one there; overwrites ``logits``."""
        _exponents(logits, self.cut)
        logits *= 1 / (logits @ _ONES[: logits.shape[1]])
        flat = logits.ravel()
        chosen = flat.take(places)
        flat[places] = chosen - 1
        return -np.log(chosen + 1e-30).sum(), logits


def _means(attended: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``kept`` positions attend to, and one over their sums of weights."""
    read = attended.reshape(-1, VALUE_WIDTH + 1).take(kept, axis=0)
    inverse = 1 / read[:, VALUE_WIDTH:]
    return read[:, :VALUE_WIDTH] * inverse, inverse


def log_probabilities(p: Parameters, before: Parameters, t: Tables, w: Windows) -> np.ndarray:
    """Natural log of each target's probability, 0 where there is none.

    ``before`` is the prior. A rank beyond the known ones gets the probability of their class.
    """
    out = np.zeros(w.target.size, np.float32)
    goal = Targets(p, before, t, w)
    read, _ = _means(attend(t, w), goal.kept)
    found = np.empty(len(read), np.float32)
    for rows, known, runs in goal.parts():
        found[rows] = goal.logs(*goal.class_logits(rows, read))
        found[rows][:known] += goal.logs(*goal.rank_logits(rows, known, runs, read))
    out[goal.kept] = found
    return out.reshape(w.target.shape)


def _summed(seen: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``d`` by input number."""
    numbers = seen.ravel().astype(np.uint16)
    order = np.argsort(numbers, kind="stable")
    numbers = numbers.take(order)
    starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    # Two columns are added at once, as the parts of a complex number.
    rows = d.reshape(-1, d.shape[-1]).view(np.complex64).take(order, axis=0)
    out = np.zeros((KNOWN + 2, d.shape[-1]), np.float32)
    out[numbers.take(starts)] = np.add.reduceat(rows, starts, axis=0).view(np.float32)
    return out


def gradients(p: Parameters, before: Parameters, w: Windows) -> tuple[float, Parameters]:
    """Mean negative log probability of the targets and its gradient."""
    t = Tables(p)
    goal = Targets(p, before, t, w)
    n, size = len(goal.kept), len(w.seen)
    parts, attended = [], np.empty((size, STRIDE, VALUE_WIDTH + 1), np.float32)
    for rows in _parts(size):
        part = w.take(rows)
        q, k, v = t.look_up(part)
        weights = t.weights(q, k, part)
        np.matmul(weights, v, out=attended[rows])
        parts.append((rows, q, k, v, weights))
    read, inverse = _means(attended, goal.kept)

    # Errors are those of the sum over targets; the mean is taken at the end.
    g = {"class": np.zeros_like(p["class"]), "rank": np.zeros_like(p["rank"])}
    loss, of_class, of_rank = 0.0, np.ascontiguousarray(p["class"].T), _turned(p["rank"])
    d_kept = np.empty((n, VALUE_WIDTH + 1), np.float32)
    d_means = d_kept[:, :VALUE_WIDTH]
    for rows, known, runs in goal.parts():
        lost, share = goal.errors(*goal.class_logits(rows, read))
        g["class"] += read[rows].T @ share
        d_part = share @ of_class
        lost_ranks, share = goal.errors(*goal.rank_logits(rows, known, runs, read))
        for c, of, mine in runs:
            g["rank"][c] += read[of].T @ share[mine]
            d_part[mine] += share[mine] @ of_rank[c]
        d_means[rows] = d_part
        loss += lost + lost_ranks

    # What a position attends to is a mean, so the sum over its weights is known from the mean.
    d_means *= inverse
    d_kept[:, VALUE_WIDTH:] = -((d_means * read) @ _ONES[:VALUE_WIDTH])
    d_read = np.zeros((size * STRIDE, VALUE_WIDTH + 1), np.float32)
    d_read[goal.kept] = d_kept
    d_read = d_read.reshape(attended.shape)
    d_seen = np.empty((size, WINDOW, _QUERIES.stop), np.float32)
    d_seen[:, :CONTEXT, _QUERIES] = 0
    d_near = np.zeros((STRIDE, WINDOW), np.float32)
    for rows, q, k, v, weights in parts:
        d_scores = np.matmul(d_read[rows], _turned(v))
        d_scores *= weights
        d_near += d_scores.sum(0)
        np.matmul(d_scores.transpose(0, 2, 1), q, out=d_seen[rows, :, _KEYS])
        np.matmul(weights.transpose(0, 2, 1), d_read[rows, :, :VALUE_WIDTH], out=d_seen[rows, :, _VALUES])
        np.matmul(d_scores, k, out=d_seen[rows, CONTEXT:, _QUERIES])
    of_seen = _summed(w.seen, d_seen)
    of_into = p["embed"].T @ of_seen
    g |= {
        "embed": of_seen @ t.into.T,
        "query": of_into[:, _QUERIES] * _SCALE,
        "key": of_into[:, _KEYS],
        "value": of_into[:, _VALUES],
        "near": np.bincount(_DISTANCE.ravel(), d_near.ravel(), WINDOW).astype(np.float32),
    }
    return float(loss / n), {name: g[name] / np.float32(n) for name in p}


class Adam:
    """Steps along averaged gradients, each divided by its usual size, for all parameters in one row."""

    def __init__(self, p: Parameters, rate: float):
        self.rate, self.steps, self.names = rate, 0, list(p)
        self.values = np.concatenate([v.ravel() for v in p.values()])
        ends = np.cumsum([v.size for v in p.values()])[:-1]
        #: Views of the row.
        self.p = {k: v.reshape(p[k].shape) for k, v in zip(p, np.split(self.values, ends), strict=True)}
        self.mean, self.size = np.zeros_like(self.values), np.zeros_like(self.values)

    def step(self, g: Parameters) -> None:
        self.steps += 1
        v = np.concatenate([g[k].ravel() for k in self.names])
        self.mean += (v - self.mean) * np.float32(0.1)
        self.size += (v * v - self.size) * np.float32(0.01)
        mean = self.mean / (1 - 0.9**self.steps)
        size = self.size / (1 - 0.99**self.steps)
        self.values -= (self.rate * mean / (np.sqrt(size) + 1e-8)).astype(np.float32)


class Trainer:
    """Parameters that learn from windows given one set after the other, each taken once a pass."""

    def __init__(self, p: Parameters, before: Parameters, rate: float, at_once: int = 64):
        self.before, self.rate, self.at_once = before, rate, at_once
        self.adam = Adam(p, rate)
        self.p = self.adam.p

    def learn(self, w: Windows, passes: int, seed) -> None:
        """Learn ``passes`` times from windows in a seeded order; the rate falls to a tenth."""
        draw, n = np.random.default_rng(seed), len(w.target)
        total, done = passes * -(-n // self.at_once), 0
        for _ in range(passes):
            order = draw.permutation(n)
            for start in range(0, n, self.at_once):
                self.adam.rate = self.rate * (1 - 0.9 * done / total)
                self.adam.step(gradients(self.p, self.before, w.take(order[start : start + self.at_once]))[1])
                done += 1


def train(
    p: Parameters, before: Parameters, w: Windows, rate: float, passes: int, seed: int, at_once: int = 64
) -> Parameters:
    """``p`` after ``passes`` over the windows in a seeded order; the rate falls to a tenth."""
    trainer = Trainer(p, before, rate, at_once)
    trainer.learn(w, passes, seed)
    return trainer.p
