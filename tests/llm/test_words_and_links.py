import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from benchsieve.llm import linking, op5_near_dedup, op9_fingerprints, words
from tests.llm.brute import near_components, shingles

TEXT = st.text(alphabet="ab C\t\n\x0b\xa0é.", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_shingle_sets_have_the_right_sizes_and_equalities(texts):
    sets = words.distinct(*words.shingle_hashes(pa.array(texts, pa.string())))
    plain = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a, pa_ in zip(sets, plain, strict=True):
        for b, pb in zip(sets, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(pa_ & pb)


def test_signatures_estimate_similarity():
    base = [f"w{i}" for i in range(400)]
    other = base[:360] + [f"x{i}" for i in range(40)]
    texts = pa.array([" ".join(base), " ".join(other), ""])
    hashes, bounds = words.shingle_hashes(texts)
    signature = words.Permutations(1024, 1).signatures(hashes, bounds)
    true = len(shingles(texts[0].as_py()) & shingles(texts[1].as_py()))
    true /= len(shingles(texts[0].as_py()) | shingles(texts[1].as_py()))
    assert abs((signature[0] == signature[1]).mean() - true) < 0.06
    assert (signature[2] == 0xFFFFFFFF).all()


def test_odd_sketch_bits_follow_the_difference():
    rng = np.random.default_rng(0)
    spec = op5_near_dedup.NearDedup()
    a = rng.integers(0, 2**32, (1, spec.samples), dtype=np.uint32)
    b = a.copy()
    b[0, : int(0.15 * spec.samples)] += 1
    bits = op5_near_dedup.odd_sketch(np.vstack([a, a, b]))
    differing = [sum(int(x).bit_count() for x in (bits[0] ^ bits[i]).view(np.uint64)) for i in (1, 2)]
    assert differing[0] == 0
    assert 200 < differing[1] <= spec.most_bits


def test_components_over_chains_and_cliques(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in linking.components(df).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert linking.components(df.where("a < 0")).count() == 0


def near_documents():
    """Copies, near copies on both sides of the threshold, a chain, and odd rows."""
    base = [f"w{i}" for i in range(300)]
    rows = [(50, " ".join(base)), (10, " ".join(base).upper()), (11, None), (12, " \n"), (13, "a b"), (14, "A\tb")]
    for n in range(1, 40):  # one change costs five shingles
        changed = list(base)
        for k in range(n % 13):
            changed[(k * 23 + n) % 300] = f"y{n}-{k}"
        rows.append((100 + n, " ".join(changed)))
    rows.append((900, " ".join(f"v{i}" for i in range(30_000))))
    rows.append((901, " ".join(f"v{i}" for i in range(30_000)) + " end"))
    return rows


@pytest.mark.parametrize("percent,spec", [(85, op5_near_dedup.NearDedup()), (80, op5_near_dedup.NearDedup(80, 7, 48))])
def test_near_duplicates_match_brute_force(spark, percent, spec):
    rows = near_documents()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, keys int")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op5_near_dedup.near_duplicates(docs, spec).collect()}
    expected = near_components(rows, percent)
    assert found == {k: (n, c, c == k) for k, (n, c) in expected.items()}


def test_near_duplicates_without_keys_repeated_and_empty(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, None)], "doc_id long, text string"
    )
    found = sorted(map(str, op5_near_dedup.near_duplicates(docs).collect()))
    assert len(found) == 4
    assert sum("kept=True" in r for r in found) == 4
    assert op5_near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_classes_of_a_repeated_document_are_one_component(spark):
    a, b, c = ("a b c d e f", "g h i j k l", "m n o p q r")
    rows = [(2, a), (5, a), (5, b), (5, None), (7, b), (8, c), (8, c), (9, c), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in op5_near_dedup.near_duplicates(docs).collect())
    assert found == [(2, 2, True), (4, 4, True), *[(5, 2, False)] * 3, (7, 2, False), *[(8, 8, True)] * 2, (9, 8, False)]


def test_minhash_links_match_brute_force(spark):
    rows = near_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = op9_fingerprints.near_duplicates(docs, 80)
    found = {r.id: r.component for r in linking.components(links).collect()}
    assert {k: found.get(k, k) for k, _ in rows} == {k: c for k, (_, c) in near_components(rows, 80).items()}


def test_fingerprints_and_edited_texts(spark):
    import hashlib

    rows = [(3, "one two three four five six"), (2, None), (9, "é" * 7), (5, "x " * 30_000), (1, "one two three four five six"), (None, "last")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, fingerprint string")
    found = {r.doc_id: r for r in op9_fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -(2**40 if r[0] is None else -r[0]) if r[0] is None else -r[0])
    order = [r for r in order if r[0] is not None] + [r for r in order if r[0] is None]
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert found[key].n_chars == len(text)
        assert found[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert found[1].fingerprint == found[3].fingerprint != ""
    assert found[2].fingerprint == "" and found[2].near_edited == 1.0
    one = op9_fingerprints.edited_fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op9_fingerprints.edited_fingerprints(docs.where("false")).count() == 0
    plain = {r.doc_id: r.fingerprint for r in op9_fingerprints.fingerprints(docs).collect()}
    assert plain == {k: r.fingerprint for k, r in found.items()}


def test_bucket_search(spark):
    for bounds in ([], [5], [1, 4, 9], list(range(0, 100, 7))):
        values = spark.range(-3, 110)
        rows = values.select("id", op9_fingerprints.bucket_of(values["id"], bounds).alias("b")).collect()
        assert all(r.b == sum(x < r.id for x in bounds) for r in rows)


def test_templated_documents_are_not_compared_in_pairs(spark, monkeypatch):
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*template, *(f"d{i}x{k}" for k in range(18 + i % 4))])) for i in range(1500)]
    rows.append((9001, rows[700][1] + " one"))  # like 700 alone
    rows += [(9100 + i, " ".join([*template[:190], *(f"e{i // 30}y{k}" for k in range(30)), f"z{i}"])) for i in range(60)]
    confirmed, plain = [], linking.confirm_on_texts

    def counting(docs, percent):
        confirm = plain(docs, percent)

        def counted(pairs):
            kept = linking.settle(pairs)
            confirmed.append(kept.count())
            return confirm(kept)

        return counted

    monkeypatch.setattr(linking, "confirm_on_texts", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in op5_near_dedup.near_duplicates(docs).collect()}
    wanted = {i: i for i in range(1500)} | {9001: 700}
    wanted |= {9100 + i: 9100 + i // 30 * 30 for i in range(60)}
    assert found == wanted
    # Stars take one pair for each bucket; what is left open takes next to none.
    assert confirmed[1] < len(rows) and sum(confirmed) < 20 * len(rows)


def test_prefixes_keep_every_similar_pair(spark):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(160):
        words_ = [f"w{k}" for k in range(60 + i % 7)]
        for at in draw.choice(60, i % 4, replace=False):
            words_[at] = f"c{draw.integers(0, 9)}"
        rows.append((i, " ".join(words_)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.selectExpr("doc_id AS id", "doc_id AS component")
    for percent in (70, 85):
        pairs = {tuple(r) for r in linking.narrowed(linking.rare_prefixes(docs, percent)(asked), percent).collect()}
        sets = [shingles(t) for _, t in rows]
        similar = {
            (i, j) for j in range(160) for i in range(j)
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i] != sets[j]
        }
        assert similar and similar <= pairs


def test_edited_texts_of_many_rows_without_keys(spark):
    import hashlib

    rows = [(None if i % 3 else i * 7 - 900, f"text {i} " * (1 + i % 5) if i % 50 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ordered = op9_fingerprints.in_order(docs)
    dealt = {r.bucket: r["count"] for r in ordered.where("doc_id IS NULL AND NOT ahead").groupBy("bucket").count().collect()}
    assert len(dealt) > 4 and max(dealt.values()) < 1000 / 3
    found = op9_fingerprints.edited_fingerprints(docs).collect()
    assert len(found) == len(rows)
    # Every text is the next one of exactly one row; keyed rows follow each other downwards.
    keyed = {k: t or "" for k, t in rows if k is not None}
    order = sorted(keyed, reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in found if r.doc_id is not None}
    for key, after in zip(order, order[1:]):
        text, cut = keyed[key], len(keyed[key]) // 3
        assert got[key] == hashlib.sha256((text[: len(text) - cut] + keyed[after][:cut]).encode()).hexdigest()


def test_the_plan_does_not_grow_with_the_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'some text' AS text")
    sizes, kept = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (10, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            sizes.append(len(op9_fingerprints.in_order(docs)._jdf.queryExecution().analyzed().toString()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sizes[1] < 1.3 * sizes[0]


def test_packed_digits_differ_where_digits_do(spark):
    draw = np.random.default_rng(6)
    a = draw.integers(0, 16, (40, 256)).astype(np.uint8)
    b = np.where(draw.random((40, 256)) < 0.3, draw.integers(0, 16, (40, 256)), a).astype(np.uint8)
    rows = list(zip(range(40), op9_fingerprints.packed(a).tolist(), op9_fingerprints.packed(b).tolist()))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    found = df.select("i", op9_fingerprints.differing_digits(df["a"], df["b"]).alias("n")).orderBy("i").collect()
    assert [r.n for r in found] == (a != b).sum(1).tolist()
