"""A Merkle manifest of documents per source, with a proof for every document.

The leaves of a source stand in the order of their doc_id, but are never sorted. A source's
doc_ids form a bitmap of 64-bit words, of which only those with a bit are kept. Partial
bitmaps of all tasks merge by OR, and a running sum of the words' row counts makes the popcount
directory: the place of a leaf is the directory's count before its word, plus the bits below
its own in the word. Only the directory, one row per 64 dense ids, is put in order.

Places key the slot arrays: 3**5 successive nodes of a source are one array, which a task
reduces by up to five levels of runs of three. The arrays' nodes are dealt into arrays again
until each source has one node, its subroot. The subroots, ordered by source, are the leaves of
a last tree of the same kind. The way down hands each array the proof of its own node, so that
every leaf gets its whole proof from its array and one row.

A word with more rows than bits holds a repeated doc_id. Only the rows of such words are sorted,
by (doc_id, leaf), over many tasks; so are rows without doc_id, which stand before all others of
their source. Rows alike in both get neighbouring places. A null source is a source of its own,
before all others. Null fields are hashed as ``-``. Texts are hashed whole. An empty table gives
an empty manifest. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle
from benchsieve.functions.numbering import number_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels that one slot array reduces at once.
LEVELS = 5
SLOTS = FAN**LEVELS
#: Stands for the word of rows without doc_id; no doc_id has a word as low.
_NO_WORD = -(2**63)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(framed)


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def levels_above(n: Column) -> Column:
    """Levels until ``n`` nodes are one; whole numbers only, so it is exact."""
    powers = F.array(*[F.lit(FAN**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def running_totals(directory: DataFrame) -> DataFrame:
    """Add ``before``: the rows of earlier words of the source, over sorted ranges of words."""
    ranged = directory.repartitionByRange("source", "word_no").sortWithinPartitions("source", "word_no")
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()))
    spans = ranged.groupBy("source", "_part").agg(F.sum("n_rows").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first source of a range goes on from an earlier one: a row per range at most.
    carried = spans.withColumn("_carried", F.sum("_n").over(earlier)).where("_carried > 0").drop("_n")
    local = Window.partitionBy("_part", "source").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_local", F.coalesce(F.sum("n_rows").over(local), F.lit(0)))
    before = F.col("_local") + F.coalesce("_carried", F.lit(0))
    return (
        summed.join(F.broadcast(carried), ["source", "_part"], "left")
        .withColumn("before", before)
        .drop("_part", "_local", "_carried")
    )


def places(leaves: DataFrame) -> DataFrame:
    """Add ``slot``, the place from 0 of each leaf (source, doc_id, leaf) in its source.

    ``leaves`` is read twice, so it should be a written table, and its source is not null.
    """
    key = F.col("doc_id")
    keyed = leaves.withColumn("word_no", F.coalesce(F.shiftright(key, 6), F.lit(_NO_WORD)))
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    words = keyed.groupBy("source", "word_no").agg(
        F.coalesce(F.bit_or(bit), F.lit(0)).alias("word"), F.count(F.lit(1)).alias("n_rows")
    )
    directory = settle(running_totals(words))
    found = keyed.join(directory, ["source", "word_no"])
    repeated = F.col("n_rows") > F.bit_count("word")
    lower_bits = F.expr("~shiftleft(-1L, cast(doc_id & 63 as int))")
    below = F.bit_count(F.col("word").bitwiseAND(lower_bits)).cast("long")
    extra = ("word_no", "word", "n_rows", "before")
    once = found.where(~repeated).withColumn("slot", F.col("before") + below).drop(*extra)
    again = found.where(repeated).withColumn("_row", F.monotonically_increasing_id())
    order = [F.coalesce(key, F.lit(0)).alias("_key"), "*"]
    again = number_rows(again.select(*order), ["_key", "leaf", "_row"], ["source", "word_no"], "_place")
    again = again.withColumn("slot", F.col("before") + F.col("_place") - 1)
    return once.unionByName(again.drop("_key", "_row", "_place", *extra))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduce_slots(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from ``nodes`` up; runs of ``FAN`` become their digest."""
    tree = [nodes]
    for _ in range(levels):
        nodes = [_digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        tree.append(nodes)
    return tree


def slot_path(tree: list[list[str]], place: int) -> list[str]:
    """Digests left and right of the node in its run, for each level of ``tree`` below its top."""
    path = []
    for nodes in tree[:-1]:
        first = place - place % FAN
        path += ["".join(nodes[first:place]), "".join(nodes[place + 1 : first + FAN])]
        place //= FAN
    return path


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["items", "levels"]).to_pylist()
        tops = [reduce_slots([i["node"] for i in r["items"]], r["levels"])[-1][0] for r in rows]
        columns = [batch.column(c) for c in ("source", "n", "slot")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(tops, pa.string())], ["source", "n", "slot", "node"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node of an array, with the proof from the node to the root."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            r = row.select(["slot", "levels", "path"]).to_pylist()[0]
            items = row.column("items").flatten()
            tree = reduce_slots(items.field("node").to_pylist(), r["levels"])
            places = range(len(items))
            out = {c: row.column(c).take(pa.array([0] * len(items))) for c in ("source", "top")}
            out |= {f.name: items.field(f.name) for f in items.type if f.name != "place"}
            out["slot"] = pa.array([r["slot"] * SLOTS + k for k in places], pa.int64())
            path = [slot_path(tree, k) + r["path"] for k in places]
            out["path"] = pa.array(path, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)


def slot_arrays(nodes: DataFrame, round_no: int) -> DataFrame:
    """Arrays of ``SLOTS`` nodes (source, n, slot, node, ...) by their slots, one row each."""
    kept = [c for c in nodes.columns if c not in ("source", "n", "slot")]
    item = F.struct((F.col("slot") % SLOTS).cast("int").alias("place"), *kept)
    arrays = nodes.groupBy("source", F.expr(f"slot div {SLOTS}").alias("slot")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("n").alias("n")
    )
    left = levels_above(F.col("n")) - round_no * LEVELS
    return arrays.withColumn("levels", F.least(F.greatest(left, F.lit(0)), F.lit(LEVELS)))


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every round, and (source, node) of each source's one node at the top.

    ``leaves`` are (source, n, slot, node, ...), n being the leaves of the source.
    """
    largest = leaves.agg(F.max(levels_above(F.col("n")))).first()[0] or 0
    rounds, nodes = [], leaves
    for k in range(max(1, -(-largest // LEVELS))):
        rounds.append(settle(slot_arrays(nodes, k)))
        nodes = rounds[-1].mapInArrow(_reduced, "source string, n long, slot long, node string")
    return rounds, settle(nodes.select("source", "node"))


def hand_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves with ``path``, their proof; ``tops`` has (source, path, top) of each tree."""
    above = tops.withColumn("slot", F.lit(0).cast("long"))
    for k, arrays in reversed(list(enumerate(rounds))):
        item = arrays.schema["items"].dataType.elementType
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in item if f.name != "place")
        top = above.schema["top"].dataType.simpleString()
        schema = f"source string, top {top}, {kept}, slot long, path array<string>"
        rows = arrays.join(above.select("source", "slot", "path", "top"), ["source", "slot"])
        above = rows.mapInArrow(_handed_down, schema)
        if k:
            above = settle(above)
    return above


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, claimed, subroot, root, path) of every row of ``docs``.

    ``leaf`` and ``claimed`` are digests over columns of ``docs`` (doc_id, source, ...);
    ``claimed`` is what a reader holds to be the leaf, the leaf itself by default. ``path`` has
    the digests left and right of the node, level by level from the leaf to the root.
    """
    # Null becomes "", any other source gets a mark in front: the order of bytes stays.
    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    leaves = settle(
        docs.select(
            source.alias("source"),
            F.col("doc_id").cast("long").alias("doc_id"),
            leaf.alias("leaf"),
            (leaf if claimed is None else claimed).alias("claimed"),
        )
    )
    sizes = settle(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    placed = places(leaves).withColumnRenamed("leaf", "node").join(sizes, "source")
    rounds, subroots = build(placed)
    ordered = number_rows(subroots, ["source"], name="slot").withColumn("slot", F.col("slot") - 1)
    tree = ordered.select(
        F.lit("").alias("source"), F.lit(sizes.count()).cast("long").alias("n"), "slot", "node", F.col("source").alias("own")
    )
    upper, root = build(settle(tree))
    start = root.select("source", F.array().cast("array<string>").alias("path"), F.col("node").alias("top"))
    tops = hand_down(upper, start).select(
        F.col("own").alias("source"), "path", F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top")
    )
    return hand_down(rounds, settle(tops)).select(
        "doc_id", F.col("node").alias("leaf"), "claimed", "top.subroot", "top.root", "path"
    )


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(path, ""), 256)


def fold(path: Column, digest: Column) -> Column:
    """The root that ``digest`` leads to along a proof."""
    levels = F.sequence(F.lit(0), (F.size(path) / 2 - 1).cast("int"))
    levels = F.when(F.size(path) > 0, levels).otherwise(F.array().cast("array<int>"))

    def step(node: Column, k: Column) -> Column:
        return F.sha2(F.concat(F.get(path, 2 * k), node, F.get(path, 2 * k + 1)), 256)

    return F.aggregate(levels, digest, step)
