import io
import math

import numpy as np
import pytest

from benchsieve.llm import op3_neighbours, op6_url_filter, op8_warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("EXAMPLE.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "zap")]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    rules = {}
    for h, p, v in RULES:
        if h:
            rules[h.lower(), p] = min(v, rules.get((h.lower(), p), v))
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules_match_brute_force(spark):
    hosts = ["net", "example.net", "b.a.Example.NET", "xexample.net", "example.com", "x.org", "org", "net:80", "", "a..net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/de/x?y=/en/", "/fr/#z", "?q", "#/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "no url", "x://y://net/", "http://net/a\nb"]
    rows = [(i, u, "k") for i, u in enumerate(urls)] + [(None, "http://net/", "k"), (0, urls[0], "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = op6_url_filter.judge(pages, rules).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found])) == sorted(str((i, *plain_verdict(u))) for i, u, _ in rows)
    assert op6_url_filter.judge(pages.where("false"), rules).count() == 0
    alone = op6_url_filter.judge(pages, rules.where("false"), "block").collect()
    assert len(alone) == len(rows) and {(r.rule, r.verdict) for r in alone} == {(None, "block")}


def test_rules_reach_over_partitions(spark):
    pages = spark.range(0, 4000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.example.net/en/', id) AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = op6_url_filter.judge(pages, rules).groupBy("rule", "verdict").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert [tuple(r) for r in found] == [("example.net/en/", "allow", 4000)]


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 200
    rows = [(1, "http://a/", "x" * 99), (2, "http://b/\n", "x" * 99), (3, None, long), (4, "http://c/", long), (7, "u", None), (8, "u", ""), (None, "u", long), (4, "http://c/", long), (9, "u", "big " * 300_000), (5, "u", "y" * 100), (6, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives = op8_warc.archive_pages(pages)
    found = op8_warc.read_archives(archives).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in found), key=key)
    wanted = []
    for page_id, _, html in rows:
        size = len((html or "").encode())
        same = [p for p, _, h in rows if h == html and p is not None]
        first = min(same, default=None) if size >= 100 else page_id
        revisit = first is not None and first != page_id
        wanted.append((page_id, "revisit" if revisit else "response", size, first if revisit else None))
    assert got == sorted(wanted, key=key)
    payloads = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert payloads[9] == "big " * 300_000 and payloads[3] == long and payloads[7] == ""
    assert op8_warc.read_archives(op8_warc.archive_pages(pages.where("false"))).count() == 0


def archive_of(tmp_path, records):
    path = str(tmp_path / "a.warc.zst")
    writer = op8_warc.ArchiveWriter(path)
    for r in records:
        writer.add(r)
    writer.close()
    with open(path, "rb") as f:
        return f.read()


def test_reader_loads_the_dictionary_and_finds_faults(tmp_path):
    records = [op8_warc.record_bytes(i, "http://x/", b"payload %d " % i * 50, None) for i in range(300)]
    data = archive_of(tmp_path, records)
    assert data[:4] == op8_warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert [r.page_id for r in op8_warc.read_archive(io.BytesIO(data), 1000)] == list(range(300))
    with pytest.raises(ValueError, match="within a frame"):
        list(op8_warc.read_archive(io.BytesIO(data[:-5])))
    good = records[0]
    for bad, message in [
        (good.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (good.replace(b"WARC-Date", b"Other"), "lacking"),
        (good + b"x", "another length"),
        (good.replace(b"payload 0", b"payload 1"), "digest"),
    ]:
        with pytest.raises(ValueError, match=message):
            op8_warc.parse_record(bad)


def nearest(rows, k):
    usable = {}
    for key, vector in rows:
        if key is None or not vector or len(vector) != 8 or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
            continue
        usable[key] = np.array(vector, float)
    out = {}
    for q, v in usable.items():
        if q % 20 == 0:
            scores = sorted((-float((v * w).sum()), key) for key, w in usable.items() if key != q)
            out[q] = [key for _, key in scores[:k]]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, hashes int")
    found = {}
    for r in op3_neighbours.search(df, df.where("vec_id % 20 = 0"), 20, **options).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [near[i] for i in sorted(near)] for q, near in found.items()}


def test_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 30] + 0.1 * rng.standard_normal(8))]) for i in range(900)]
    found, true = search(spark, rows), nearest(rows, 20)
    hits = sum(len(set(found[q]) & set(true[q])) for q in true)
    assert found.keys() == true.keys() and hits >= 0.9 * 20 * len(true)
    assert all(len(found[q]) == 20 and q not in found[q] for q in true)


def test_neighbours_of_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [(i, one) for i in range(0, 200)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0]), (380, [None] * 8), (None, one), (0, one), (400, [0.5] * 8)]
    found = search(spark, rows)
    assert set(found) == {*range(0, 200, 20), 400}
    assert found[0] == list(range(1, 21)) and found[20] == [i for i in range(21) if i != 20]
    assert found[400] == list(range(20))
    few = search(spark, rows[:3])
    assert few == {0: [1, 2]}
    assert search(spark, []) == {} and search(spark, [(20, None)]) == {}


def test_queries_of_a_block_are_dealt_over_bounded_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i * 20, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(600)]
    whole = search(spark, rows)
    sizes = []
    dealt = op3_neighbours._dealt

    def seen(*arguments):
        points, asked = dealt(*arguments)
        key = ["tree", "block", "chunk"]
        groups = asked.groupBy(*key).count().collect()
        assert {r[:3] for r in points.groupBy(*key).count().collect()} >= {r[:3] for r in groups}
        sizes.extend(r["count"] for r in groups)
        return points, asked

    monkeypatch.setattr(op3_neighbours, "_dealt", seen)
    monkeypatch.setattr(op3_neighbours, "CHUNK_QUERIES", 50)
    monkeypatch.setattr(op3_neighbours, "BLOCK_ROWS", 100)
    # All 600 rows are queries without structure, so most of them reach each block.
    assert search(spark, rows) == whole and len(whole) == 600
    assert max(sizes) <= 100 and sum(sizes) > 600 * op3_neighbours.TREES


def test_copies_are_bounded(monkeypatch):
    monkeypatch.setattr(op3_neighbours, "COPY_ROWS", 4)
    parts = list(op3_neighbours._copies(np.array([2, 0, 5, 1, 0])))
    assert [len(row) for row, _ in parts] == [4, 4]
    assert np.concatenate([r for r, _ in parts]).tolist() == [0, 0, 2, 2, 2, 2, 2, 3]
    assert np.concatenate([n for _, n in parts]).tolist() == [0, 1, 0, 1, 2, 3, 4, 0]
    assert list(op3_neighbours._copies(np.zeros(0, np.int64))) == []
