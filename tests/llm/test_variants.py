import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from benchsieve.functions.durable import settle
from benchsieve.llm import op11_variants, queries
from benchsieve.llm.words import Tokens


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_match_brute_force(spark, tmp_path):
    draw = random.Random(5)
    base = ["".join(draw.choices("abéÿ", k=draw.randint(5, 8))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "ab" * 40, "ab" * 40 + "a", "ba" * 200]
    rows, n = [], 0
    for k, word in enumerate(base):
        for times in (6, 40) if k % 3 else (200,):
            rows.append((n, "".join(f"{word.title() if i % 2 else word}{' ,;-1×÷_'[i % 8]}" for i in range(times)), 1, "x"))
            n += 1
        at = draw.randrange(len(word))
        for wrong in (word[:at] + word[at + 1 :], word[:at] + "a" + word[at:], word[:at] + "b" + word[at + 1 :]):
            rows.append((n, " ".join([wrong] * draw.randint(4, 9)), 1, "x"))
            n += 1
    rows += [(None, "keyless " * 30, 1, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (4, "", 1, "x"), (3, "repeated " * 3, 1, "x"), (3, "repeated " * 3, 1, "x")]
    rows += [(n + 1, "chained " * 400, 1, "x"), (n + 2, "chainedd " * 60, 1, "x"), (n + 3, "chaineddé " * 7, 1, "x")]
    rows.append((n, "lengthy1" * 50_000, 1, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    wanted = plain_variants(plain_counts([r[:2] for r in rows]))
    assert found == wanted
    assert sum(1 for w in wanted if w[1]) > 10 and any(w[1] != w[2] for w in wanted if w[1])


def test_no_words_no_variants(spark):
    docs = spark.createDataFrame([(1, "short 1 2"), (2, None)], "doc_id long, text string")
    assert op11_variants.variants(docs).count() == 0
    assert op11_variants.variants(docs.where("false")).count() == 0


def test_chains_of_any_length_end_at_the_root(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("v", "w005")]
    found = dict(map(tuple, op11_variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert found == {w: "w037" for w, _ in rows}


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(op11_variants, "settle", noted)
    docs = spark.createDataFrame([(1, "lengthy " * 50), (2, "lengthyy " * 6 + "lengthi " * 5)], "doc_id long, text string")
    found = op11_variants.variants(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r["word"]: r["root"] for r in found.collect()} == dict.fromkeys(("lengthy", "lengthyy", "lengthi"), "lengthy")
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("0123456789", max_size=5), st.text("abÀÿ zß", max_size=90)), max_size=5))
def test_hashes_of_key_and_run(rows):
    runs = Tokens(op11_variants.only_runs(pa.array([None, *(t for _, t in rows)], pa.string()).slice(1)))
    found = op11_variants.run_hashes([f"{k}:".encode() for k, _ in rows], runs)
    wanted = [zlib.crc32(f"{k}:{run}".encode()) for k, t in rows for run in re.findall("[a-zÀ-ÿ]+", t)]
    assert found.tolist() == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 9), st.data())
def test_pivots_are_the_cheapest_disjoint_pair(width, data):
    costs = data.draw(st.lists(st.integers(0, 9), min_size=width, max_size=width))
    prefix = data.draw(st.sets(st.integers(0, width - 1), min_size=3))
    mask = np.isin(np.arange(width), list(prefix))
    a, b = (int(x[0]) for x in op11_variants.pivots(np.array([costs]), mask[None]))
    pairs = [(i, j) for i in prefix for j in prefix if j - i >= 2]
    assert (a, b) in pairs and costs[a] + costs[b] == min(costs[i] + costs[j] for i, j in pairs)
