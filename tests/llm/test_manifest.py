import hashlib
import zlib

from pyspark.sql import functions as F

from benchsieve.llm import op12_merkle, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(fields):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def plain_siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append((nodes[first:at], nodes[at + 1 : first + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) as the query returns them."""
    held = {}
    for row in rows:
        held.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        held[s].sort(key=lambda x: x[:3])
        trees[s] = plain_levels([x[2] for x in held[s]])
    top = plain_levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(held[s]):
            path = plain_siblings(trees[s], at) + plain_siblings(top, k)
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = plain_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in path:
                node = digest("".join([*left, node, *right]))
            proof = digest("".join("".join(a + b) for a, b in path))
            out.append((row[0], leaf, trees[s][-1][0], root, proof, node, node == root))
    return out


def found_manifest(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = queries.op12_merkle_manifest(spark, str(folder)).collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows]


def alike(found, wanted):
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(wanted, key=key)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, slot int, node string, path string"


def with_extras(rows):
    return [(*r, 7, "x", "y") for r in rows]


def test_manifest_matches_a_plain_tree(spark, tmp_path):
    rows = [(i * 7 - 900, ["a", "b", None, "é", ""][min(i % 11, 4)], "en", i, f"text {i}\n é\n{i}") for i in range(1500)]
    rows += [(5_000_000_000 + i * 2**40, "far", None, None, f"{i}\n") for i in range(40)]
    rows += [(None, "a", "de", 1, f"k{i}") for i in range(5)] + [(None, None, None, None, None)] * 3
    rows += [(-900, "a", "en", 0, "other\ntext")] * 2 + [(-893, "b", "fr", 2, "third")]
    rows += [(63, "lone", "en", 3, "one\n"), (1, "long", "en", 3, "ab\n" * 200_000), (2, "long", "en", 0, "")]
    alike(found_manifest(spark, spark.createDataFrame(with_extras(rows), SCHEMA).repartition(5), tmp_path), plain_manifest(rows))


def test_manifest_of_one_source_and_of_nothing(spark, tmp_path):
    rows = [(i, "s", "en", 1, "x\n") for i in range(244)]
    alike(found_manifest(spark, spark.createDataFrame(with_extras(rows), SCHEMA), tmp_path / "a"), plain_manifest(rows))
    one = rows[:1]
    alike(found_manifest(spark, spark.createDataFrame(with_extras(one), SCHEMA), tmp_path / "b"), plain_manifest(one))
    assert found_manifest(spark, spark.createDataFrame([], SCHEMA), tmp_path / "c") == []


def test_many_repeated_and_keyless_rows_get_places_of_their_own(spark):
    rows = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, null, id % 90 - 45) AS doc_id", "'s' AS source", "lpad(string(id % 777), 5, '0') AS leaf"
    )
    placed = op12_merkle.places(op12_merkle.settle(rows)).orderBy("slot").collect()
    assert [r.slot for r in placed] == list(range(20_000))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.leaf) for r in placed]
    assert keys == sorted(keys)


def test_places_survive_a_directory_over_many_ranges(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(-9000, 9000).selectExpr("id * 31 AS doc_id", "if(id % 5 = 0, 'b', 'a') AS source", "'x' AS leaf")
        placed = op12_merkle.places(op12_merkle.settle(rows)).groupBy("source").agg(
            F.collect_list(F.struct("doc_id", "slot")).alias("held")
        )
        for r in placed.collect():
            held = sorted((h.doc_id, h.slot) for h in r.held)
            assert [s for _, s in held] == list(range(len(held)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
