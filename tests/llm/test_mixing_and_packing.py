import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from benchsieve.llm import op2_mixing, op4_token_shards, op10_packing
from tests.llm.brute import words_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_quotients(weights, seats):
    given = [0] * len(weights)
    for _ in range(seats if sum(weights) > 0 else 0):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 60))
def test_apportionment_is_by_highest_quotients(weights, seats):
    found = op2_mixing.apportion(weights, seats)
    wanted = by_quotients(weights, seats)
    assert sum(found) == sum(wanted)
    # Equal quotients may fall to another source, but no seat to a lower one.
    used = lambda given: sorted(w / (2 * k + 1) for w, n in zip(weights, given) for k in range(n))
    assert used(found) == pytest.approx(used(wanted))


def test_targets_reshare_the_excess():
    assert op2_mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert op2_mixing.targets([0, 10], [3, 1], 1.5, 2) == pytest.approx([0, 15])
    assert op2_mixing.targets([], [], 1.5, 2) == []


def mixing_rows():
    rows = []
    for i in range(400):
        source = [None, "b", "a", "é", "Z"][i % 5] if i % 3 else "b"
        rows.append((i, " ".join(["w"] * (i % 97)) if i % 11 else None, source, 7, "x"))
    rows += [(None, "k k k", "a", 7, "x"), (5, "again and again", "b", 7, "x"), (5, "again and again", "b", 7, "x")]
    rows.append((1000, "long " * 50_000, "Z", 7, "x"))
    return rows


def test_mix_keeps_targets_and_reruns_agree(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, m_key string")
    result = op2_mixing.mix(docs).repartition(3)
    found = result.collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(words_of(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    goals = dict(zip(names, op2_mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)))
    taken = defaultdict(int)
    for r in found:
        assert r["size"] == len(words_of(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.m_key == "x"
        taken[r.source] += r.taken
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= op2_mixing.BLOCK_WORDS
    again = op2_mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken, r.source)
    assert Counter(map(key, found)) == Counter(map(key, again))


def test_mix_of_nothing_and_of_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert op2_mixing.mix(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], schema)
    assert [r.taken for r in op2_mixing.mix(empty).collect()] == [0, 0]


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(mixing_rows(), "doc_id long, text string, source string, size int, target string")
    mixed = op2_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    expected = Counter()
    for r in op2_mixing.mix(docs.select("doc_id", "text", "source")).collect():
        if r["size"] and r.taken:
            expected[r.doc_id] += int(np.floor(r.taken / r["size"] + 0.5))
    assert copies == +expected


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_matching_places_every_document_once(counts):
    plan = op10_packing.match(counts, 40)
    used = defaultdict(list)
    placed = Counter()
    for length, first, end, per, sequence, offset in plan:
        for rank in range(first, end):
            placed[length, rank] += 1
            at = offset + (rank - first) % per * length
            used[sequence + (rank - first) // per].append((at, at + length))
    assert placed == Counter((n, r) for n, c in counts.items() for r in range(c))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 40
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    # As many sequences as the sequential algorithm opens.
    lengths = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
    assert len(used) == op4_token_shards.best_fit_decreasing(lengths, 40)[2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_segment_tree_finds_the_tightest_gap(lengths):
    row, offset, n = op4_token_shards.best_fit_decreasing(np.array(lengths, np.int64), 16)
    gaps = []
    for i in np.argsort(-np.array(lengths, np.int64), kind="stable"):
        fitting = [g for g in gaps if g >= lengths[i]]
        gap = min(fitting, default=16)
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - lengths[i])
        assert offset[i] == 16 - gap
    assert n == len(gaps)


def documents(spark):
    texts = ["Hello, World. It's 3.5%!", None, "", "naïve CAFÉ e\u0301 don't", "<|endoftext|> x", "a" * 3000, "tail., x).", "word " * 9000, "word " * 9000, "\u0958 \u3000 中文 字 ǅ"]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, "three", 1, 2), (None, "none", 1, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length int, piece int")


def expected_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = Counter()
    for key, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out[key, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check_places(rows, sequence, capacity):
    spans = defaultdict(list)
    for r in rows:
        spans[sequence(r)].append((r.offset, r.offset + r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_packing_is_whole_and_gapless(spark):
    rows, docs = documents(spark)
    found = op10_packing.pack_documents(docs, PATH).collect()
    got = Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in found)
    assert got == expected_pieces(rows, 4096)
    check_places(found, lambda r: r.sequence_id, 4096)
    assert op10_packing.pack_documents(docs.where("false"), PATH).count() == 0


def test_pieces_hold_the_ids(spark):
    rows, docs = documents(spark)
    for r in op10_packing.pieces(docs, PATH, capacity=64, with_ids=True).collect():
        assert len(r.ids) == r["length"] and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_shards_round_trip(spark):
    rows, docs = documents(spark)
    shards = op4_token_shards.write_shards(docs.repartition(2), PATH, capacity=512, shard_tokens=4000)
    found = op4_token_shards.read_shards(shards).collect()
    got = Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in found)
    assert got == expected_pieces(rows, 512)
    check_places(found, lambda r: (r.shard, r.sequence), 512)
    assert op4_token_shards.write_shards(docs.where("false"), PATH).count() == 0


def test_a_damaged_shard_is_an_error():
    pieces = [(1, 0, 0, np.array([5, 6, 1], np.uint16)), (2, 0, 0, np.array([7, 1], np.uint16))]
    shard = op4_token_shards.shard_arrays(pieces, 8)
    assert len(list(op4_token_shards._segments("x", shard, 2))) == 1
    shard["cumulative"] = shard["cumulative"] + 1
    shard["length"] = shard["length"][::-1]
    with pytest.raises(ValueError):
        list(op4_token_shards._segments("x", shard, 2))
