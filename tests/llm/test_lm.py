import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from benchsieve.llm import attention as A
from benchsieve.llm import op13_lm, queries
from tests.llm.brute import words_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(3)
    p = {k: v + draw.normal(0, 0.3, v.shape).astype(np.float32) for k, v in A.initial().items()}
    return p, A.prior(draw.integers(0, 9, (A.KNOWN + 2, A.KNOWN + 1)).astype(float))


def plain_distribution(p, before, seen):
    """Probabilities of all ranks and the rare class after the tokens ``seen``, one by one."""
    e = p["embed"].astype(float)
    q = e[seen[-1]] @ p["query"] / math.sqrt(A.KEY_WIDTH)
    scores = [q @ (e[s] @ p["key"]) + p["near"][len(seen) - 1 - i] for i, s in enumerate(seen)]
    weights = np.exp(np.array(scores) - max(scores))
    read = (weights / weights.sum()) @ np.array([e[s] @ p["value"] for s in seen])
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    classes = softmax(read @ p["class"] + before["class"][seen[-1]])
    ranks = [softmax(read @ p["rank"][c] + before["rank"][seen[-1], c]) * classes[c] for c in range(A.CLASSES)]
    return np.append(np.concatenate(ranks), classes[-1])


def test_windows_score_every_token_once_by_what_it_may_see(model):
    p, before = model
    draw = np.random.default_rng(1)
    sizes = [1, 33, 0, 2, 90, 32]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ranks = draw.integers(0, A.KNOWN + 40, bounds[-1])
    w, text = A.windows(ranks, bounds)
    assert (w.target >= 0).sum() == bounds[-1]
    found = A.log_probabilities(p, before, A.Tables(p), w)
    for k, size in enumerate(sizes):
        mine = found[text == k][w.target[text == k] >= 0]
        assert len(mine) == size
        row = ranks[bounds[k] : bounds[k + 1]]
        for i in range(size):
            first = max(0, i // A.STRIDE * A.STRIDE - A.CONTEXT)
            before_it = [A.BEGIN, *np.minimum(row[:i], A.RARE)][first:]
            share = plain_distribution(p, before, before_it)
            assert share.sum() == pytest.approx(1, abs=1e-5)
            assert mine[i] == pytest.approx(math.log(share[min(row[i], A.KNOWN)]), abs=2e-4)


def test_gradients_agree_with_differences(model):
    p, before = model
    draw = np.random.default_rng(2)
    w, _ = A.windows(draw.integers(0, A.KNOWN + 9, 150), np.array([0, 70, 150]))
    _, g = A.gradients(p, before, w)
    for name in p:
        way = draw.normal(0, 1, p[name].shape).astype(np.float32)
        step = np.float32(2e-3)
        ends = []
        for sign in (1, -1):
            moved = p | {name: p[name] + sign * step * way}
            lp = A.log_probabilities(moved, before, A.Tables(moved), w)
            ends.append(-lp.sum(dtype=np.float64) / (w.target >= 0).sum())
        assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(float((g[name] * way).sum()), rel=0.03, abs=3e-3)


def test_windows_hold_what_stands_around_each_place():
    sizes = [0, 1, 16, 0, 33, 64, 65, 0]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ranks = np.random.default_rng(6).integers(0, 2 * A.KNOWN, bounds[-1])
    w, text = A.windows(ranks, bounds)
    places = [(k, i) for k, size in enumerate(sizes) for i in range(0, size, A.STRIDE)]
    assert text.tolist() == [k for k, _ in places]
    for n, (k, i) in enumerate(places):
        row = ranks[bounds[k] : bounds[k + 1]]
        for j, at in enumerate(range(i - A.CONTEXT, i + A.STRIDE)):
            assert w.hidden[n, j] == (not 0 <= at < len(row))
            assert w.seen[n, j] == (min(row[at - 1], A.RARE) if 0 < at < len(row) else A.BEGIN)
        assert w.target[n].tolist() == [row[at] if at < len(row) else -1 for at in range(i, i + A.STRIDE)]
    assert len(A.windows(ranks[:0], np.zeros(3, int))[1]) == 0


@pytest.mark.parametrize("large", [1, 40])
def test_sizes_of_parts_change_nothing(model, monkeypatch, large):
    # Texts that begin and end in windows, rare ranks, classes cut by parts; large logits are cut at their bound.
    p, before = model
    p = {k: v * np.float32(large if k in ("query", "class") else 1) for k, v in p.items()}
    draw = np.random.default_rng(5)
    w, _ = A.windows(draw.integers(0, A.KNOWN + 200, 700), np.array([0, 70, 71, 400, 700]))
    wanted = A.log_probabilities(p, before, A.Tables(p), w)
    loss, g = A.gradients(p, before, w)
    monkeypatch.setattr(A, "ROWS", 7)
    monkeypatch.setattr(A, "PART", 3)
    np.testing.assert_allclose(A.log_probabilities(p, before, A.Tables(p), w), wanted, rtol=0, atol=1e-3)
    again, found = A.gradients(p, before, w)
    assert again == pytest.approx(loss, rel=1e-5)
    assert A.Tables(p).cut_logits == (large > 1)
    for name in p:
        assert found[name].shape == p[name].shape
        np.testing.assert_allclose(found[name], g[name], rtol=0, atol=1e-5 + 1e-4 * np.abs(g[name]).max())


def test_training_learns(model):
    # Text of two kinds; a token's successor depends on the kind, which only the past tells.
    draw = np.random.default_rng(4)
    rows = [(draw.integers(0, 5, 64) * 2 + k % 2) for k in range(400)]
    bounds = np.arange(401) * 64
    before = A.prior(np.zeros((A.KNOWN + 2, A.KNOWN + 1)))
    w, text = A.windows(np.concatenate(rows), bounds)
    p = A.train(A.initial(), before, w.take(text < 350), 0.01, 4, 1, at_once=16)
    lp = A.log_probabilities(p, before, A.Tables(p), w.take(text >= 350))
    assert -lp.mean() < math.log(5) + 0.15


def plain_base(rows):
    counts, n = Counter(), 0
    fold = [None if k is None else zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    for (_, text), held in zip(rows, fold):
        if not held:
            tokens = [*words_of(text), None]
            counts.update(tokens)
            n += len(tokens)
    out = []
    for (k, text), held in zip(rows, fold):
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (len(counts) + 1))) for t in tokens)
        out.append((k, bool(held), len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    return out


def lm_rows():
    rows = [(i, " ".join(["The", "cat sat", f"w{i % 7}é", "on,", "x" * (i % 5)] * (i % 23))) for i in range(300)]
    rows += [(None, "keyless cat"), (None, None), (5, "the cat"), (5, "the cat"), (400, ""), (401, "  a   b "), (402, "new" * 5000), (403, "long text " * 40_000)]
    return rows


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lm")
    docs = spark.createDataFrame([(*r, 1, "y") for r in lm_rows()], "doc_id long, text string, slice int, ids string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    kept = op13_lm.BUCKET_ENTRIES
    op13_lm.BUCKET_ENTRIES = 20  # several buckets
    try:
        return queries.op13_lm_scores(spark, str(folder)).collect()
    finally:
        op13_lm.BUCKET_ENTRIES = kept


def test_base_scores_match_brute_force(scored):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in scored), key=key)
    wanted = sorted(plain_base(lm_rows()), key=key)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in wanted])


def test_scores_are_log_probabilities_and_follow_the_text(scored):
    assert all(r.score < 0 for r in scored)
    by = {}
    for r in scored:
        by.setdefault(r.doc_id, []).append(r)
    one, other = (r.score for r in by[5] if r.n_tokens == 3)
    assert one == pytest.approx(other, abs=1e-3)
    # What was often read is likelier than what was not, token by token.
    assert by[299][0].score / by[299][0].n_tokens > by[401][0].score / by[401][0].n_tokens


def test_ids_are_those_of_each_word(spark):
    encoder = op13_lm.ByteEncoder(PATH, public_tokenizers.PATTERN)
    items = sorted({w for _, t in lm_rows() for w in words_of(t)})
    flat, sizes = encoder.encode(items)
    plain, plain_sizes = encoder.encode(items[:1])
    assert sizes.sum() == len(flat) and len(sizes) == len(items)
    at = 0
    for item, size in zip(items, sizes):
        assert encoder.encoding.decode(flat[at : at + size].tolist()) == " " + item
        at += size


def test_nothing_to_score_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    everything = F.lit(True)
    found = op13_lm.score_texts(docs, everything, PATH, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens) for r in found} == {(1, 0, 0), (2, 0, 0)}
    assert all(r.base_score == 0 and r.score < 0 for r in found)
    assert op13_lm.score_texts(docs.where("false"), everything, PATH, public_tokenizers.PATTERN).count() == 0


def test_every_training_window_teaches(spark, monkeypatch):
    monkeypatch.setattr(op13_lm, "SLICE_BYTES", 2000)  # several slices a task
    docs = spark.createDataFrame([(i, f"some words of text {i % 9} " * 30) for i in range(80)], "doc_id long, text string")
    slices = op13_lm.tokenised(docs.repartition(3), F.col("doc_id") % 4 == 1, PATH, public_tokenizers.PATTERN)
    ranks, before = np.arange(op13_lm.IDS), A.prior(np.zeros((A.KNOWN + 2, A.KNOWN + 1)))
    rounds = [op13_lm.taught(slices, ranks, A.initial(), before, k) for k in range(op13_lm.ROUNDS)]
    weights = [r.where("part = 0").agg(F.sum("weight")).first()[0] for r in rounds]
    assert slices.count() > 20 and all(weights)
    assert sum(weights) == slices.agg(F.sum("n_windows")).first()[0]
