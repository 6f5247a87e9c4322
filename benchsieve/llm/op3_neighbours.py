"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long bit string, one bit per random hyperplane through the mean
of a bounded sample, followed by bits of a hash of the key that spread equal strings. Per tree
the strings are one sorted array, cut into blocks at quantiles of a bounded sample. A query
descends to the longest prefix it shares with any string; then it ascends in all trees at the
same time, one bit by one, until the subtrees hold enough candidates. It so has, in each tree,
one run of the sorted array, whose vectors are scored exactly. The queries that reach a block
are dealt over chunks by a hash, about ``CHUNK_QUERIES`` at most in each; a block's vectors go to
each of its chunks, and to none if no query reaches it.

How many candidates are enough is measured: for ``SAMPLE_QUERIES`` queries the true neighbours
are found among all rows, and the least number of candidates that finds ``RECALL`` of them is
used for all. Data with clear neighbours need few; data without structure need a share of all.

Nearness is the inner product in double precision. To make a prefix mean nearness by inner
product, vectors are hashed with one more component that brings them to the sample's largest
norm (longer ones get none).

Vectors that are null, zero or empty, or hold null or non-finite components take no part, and
neither do vectors without key; so do vectors of another length than most of the sample. Equal
vectors form a class that is indexed once, with its smallest keys, as many as a query can
return; rows that repeat key and vector count once. Ties go to the smaller key. Fewer
candidates than asked for are all returned. Empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle

#: Rows that place hyperplanes and block borders, and queries that measure recall.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 100
TREES = 12
HASH_BITS = 31
#: Bits behind a hash that spread equal hashes over blocks.
SPREAD_BITS = 31
BLOCK_ROWS = 8192
#: Queries that meet a block in one group, and copies of rows that a task makes at once.
CHUNK_QUERIES, COPY_ROWS = 2048, 8192
LEAF_ROWS = 16
RECALL = 0.95
SEED = 3_77


@dataclass(frozen=True)
class Forest:
    """Hyperplanes of all trees, and what puts vectors on one sphere."""

    mean: np.ndarray
    norm: float
    planes: np.ndarray  # (tree, dimension + 1, bits)

    @classmethod
    def from_sample(cls, sample: np.ndarray, trees: int, seed: int) -> Forest:
        norm = float(np.sqrt((sample**2).sum(1)).max(initial=0.0))
        draw = np.random.default_rng(seed)
        planes = draw.standard_normal((trees, sample.shape[1] + 1, HASH_BITS))
        forest = cls(np.zeros(sample.shape[1] + 1), norm, planes)
        return cls(forest.lift(sample, False).mean(0), norm, planes)

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        squares = (vectors**2).sum(1)
        if query:  # a query's length does not matter
            scale = np.sqrt(np.maximum(squares, 1e-300))[:, None]
            return np.hstack([vectors / scale * self.norm, np.zeros((len(vectors), 1))])
        more = np.sqrt(np.maximum(self.norm**2 - squares, 0.0))
        return np.hstack([vectors, more[:, None]])

    def hashes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Hash strings as integers, one column per tree."""
        centred = self.lift(vectors, query) - self.mean
        out = np.empty((len(vectors), len(self.planes)), np.int64)
        weights = 1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)
        for tree, planes in enumerate(self.planes):
            out[:, tree] = (centred @ planes > 0) @ weights
        return out


def usable(vector: Column, size: int) -> Column:
    """Whether all components are finite numbers, there are ``size`` of them, and not all 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(class_id, vector, ids): equal vectors once, with their ``most`` smallest keys.

    A hot class is cut down in salted parts before its keys meet.
    """
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    marked = rows.select("vec_id", "vector", digest.alias("digest")).dropDuplicates(["vec_id", "digest"])
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    part = Window.partitionBy("digest", "salt").orderBy("vec_id")
    whole = Window.partitionBy("digest").orderBy("vec_id")
    kept = (
        marked.withColumn("salt", salt)
        .withColumn("n", F.row_number().over(part))
        .where(F.col("n") <= most)
        .withColumn("n", F.row_number().over(whole))
        .where(F.col("n") <= most)
    )
    return kept.groupBy("digest").agg(
        F.min("vec_id").alias("class_id"),
        F.min_by("vector", "vec_id").alias("vector"),
        F.sort_array(F.collect_list("vec_id")).alias("ids"),
    ).drop("digest")


def _hashed(rows: DataFrame, forest: Forest, query: bool) -> DataFrame:
    """``rows`` with hash strings of their vectors."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(hashes=list(forest.hashes(_matrix(frame["vector"]), query)))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(read, f"{columns}, hashes array<long>")


def _truth(classes: DataFrame, queries: pd.DataFrame, k: int) -> list[np.ndarray]:
    """Hash strings of the true nearest classes of a bounded number of queries."""
    wanted = _matrix(queries["vector"])
    own = queries["class_id"].to_numpy()

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = wanted @ _matrix(frame["vector"]).T
            scores[own[:, None] == frame["class_id"].to_numpy()[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            flat = top.ravel()
            yield pd.DataFrame(
                {
                    "query": np.repeat(np.arange(len(own)), top.shape[1]),
                    "score": np.take_along_axis(scores, top, 1).ravel(),
                    "hashes": list(np.stack(frame["hashes"].to_numpy())[flat]),
                }
            )

    found = classes.select("class_id", "vector", "hashes").mapInPandas(
        best, "query long, score double, hashes array<long>"
    )
    place = Window.partitionBy("query").orderBy(F.desc("score"))
    kept = found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k)
    rows = kept.where(F.col("score") > float("-inf")).toPandas()  # SAMPLE_QUERIES * k rows
    return [
        np.stack(g["hashes"].to_numpy()) if len(g) else np.zeros((0, TREES), np.int64)
        for g in (rows[rows["query"] == i] for i in range(len(own)))
    ]


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    differ = (a ^ b).astype(np.float64)
    return HASH_BITS - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0)


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest of each query, which is not its own.

    ``candidates`` and ``queries`` have vec_id and embedding; the candidates hold the queries.
    """
    spark = candidates.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def vectors(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
        return rows.where(F.col("vec_id").isNotNull())

    sizes = (
        vectors(candidates).where(F.size("vector") > 0).groupBy(F.size("vector").alias("s")).count()
    )
    common = sizes.orderBy(F.desc("count"), "s").first()
    if common is None:
        return empty
    keep = usable(F.col("vector"), common["s"])
    classes = settle(_classes(vectors(candidates).where(keep), k + 1))
    n = classes.count()
    if not n:
        return empty
    place = F.xxhash64("class_id")
    sample = classes.select("class_id", "vector").orderBy(place).limit(SAMPLE_ROWS).toPandas()
    forest = Forest.from_sample(_matrix(sample["vector"]), trees, SEED)
    indexed = settle(_hashed(classes.select("class_id", "vector"), forest, False))

    # Queries with equal vectors are one; each is expanded into its keys at the end.
    asked = vectors(queries).where(usable(F.col("vector"), common["s"]))
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    asked = settle(asked.withColumn("digest", digest).dropDuplicates(["vec_id", "digest"]))
    distinct = asked.groupBy("digest").agg(
        F.min("vec_id").alias("query"), F.min_by("vector", "vec_id").alias("vector")
    )
    members = settle(asked.select("vec_id", "digest").join(distinct.select("digest", "query"), "digest"))
    hashed = settle(_hashed(distinct.select("query", "vector"), forest, True))

    depth = max(1, min(HASH_BITS, int(np.ceil(np.log2(max(2, n / LEAF_ROWS))))))
    counts = settle(_prefix_counts(indexed, depth))
    levels = settle(_levels(hashed, counts, depth))
    enough = _enough_candidates(indexed, hashed, levels, depth, k, recall)
    chosen = levels.where(F.col("n") >= enough).groupBy("query").agg(F.max("level").alias("level"))
    chosen = hashed.join(settle(chosen), "query", "left").withColumn("level", F.coalesce("level", F.lit(0)))

    scored = _score_blocks(*_dealt(indexed, chosen, _borders(sample, forest, n)), k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    near = (
        scored.dropDuplicates(["query", "class_id"])
        .withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .select("query", "class_id", "score")
    )
    # k + 1 classes with at most k + 1 keys each: enough, as only the query's own is left out.
    rows = (
        near.join(classes.select("class_id", F.explode("ids").alias("found")), "class_id")
        .withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found")))
        .where(F.col("n") <= k + 1)
    )
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return (
        members.select(F.col("vec_id").alias("query_id"), "query")
        .join(rows.drop("n"), "query")
        .where(F.col("query_id") != F.col("found"))
        .dropDuplicates(["query_id", "found"])
        .withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")
    )


def _prefix_counts(indexed: DataFrame, depth: int) -> DataFrame:
    """(tree, level, prefix, n): the strings below each prefix of at most ``depth`` bits."""
    deepest = (
        indexed.select(F.posexplode("hashes").alias("tree", "hash"))
        .groupBy("tree", F.shiftright("hash", HASH_BITS - depth).alias("deep"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        deepest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .withColumn("prefix", F.expr(f"shiftright(deep, {depth} - level)"))
        .groupBy("tree", "level", "prefix")
        .agg(F.sum("n").alias("n"))
    )


def _levels(hashed: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """(query, level, n): the candidates of all trees when a query has ascended to a level."""
    return (
        hashed.select("query", F.posexplode("hashes").alias("tree", "hash"))
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .withColumn("prefix", F.expr(f"shiftright(hash, {HASH_BITS} - level)"))
        .join(counts, ["tree", "level", "prefix"])
        .groupBy("query", "level")
        .agg(F.sum("n").alias("n"))
    )


def _enough_candidates(
    indexed: DataFrame, hashed: DataFrame, levels: DataFrame, depth: int, k: int, recall: float
) -> int:
    """The least number of candidates that finds ``recall`` of sampled queries' neighbours."""
    some = hashed.orderBy(F.xxhash64("query")).limit(SAMPLE_QUERIES)
    sample = some.withColumn("class_id", F.col("query")).toPandas()
    if not len(sample):
        return 1
    truth = _truth(indexed, sample, k)
    reach = (
        levels.join(F.broadcast(some.select("query")), "query").orderBy("query", "level").toPandas()
    )
    by_query = {q: g.sort_values("level")["n"].to_numpy() for q, g in reach.groupby("query")}
    best = [
        np.minimum(_shared_bits(t, np.asarray(h)[None, :]).max(1), depth)
        for t, h in zip(truth, sample["hashes"], strict=True)
    ]
    total = max(1, sum(map(len, best)))

    def found(enough: int) -> float:
        hits = 0
        for q, shared in zip(sample["query"], best, strict=True):
            n = by_query.get(q, np.zeros(0))
            reached = np.flatnonzero(n >= enough)
            hits += int((shared >= (reached.max() if len(reached) else 0)).sum())
        return hits / total

    steps = sorted({int(x) for n in by_query.values() for x in n})
    low, high = 0, max(0, len(steps) - 1)
    while low < high:  # more candidates never find less
        middle = (low + high) // 2
        low, high = (low, middle) if found(steps[middle]) >= recall else (middle + 1, high)
    return steps[low] if steps else 1


def _borders(sample: pd.DataFrame, forest: Forest, n: int) -> list[np.ndarray]:
    """Per tree, the long strings at which its sorted array is cut into blocks."""
    hashes = forest.hashes(_matrix(sample["vector"]), False)
    blocks = max(1, min(len(sample), -(-n // BLOCK_ROWS)))
    spread = np.random.default_rng(SEED).integers(0, 1 << SPREAD_BITS, len(sample))
    out = []
    for tree in range(hashes.shape[1]):
        strings = np.sort((hashes[:, tree] << SPREAD_BITS) | spread)
        out.append(np.unique(strings[[len(strings) * b // blocks for b in range(1, blocks)]]))
    return out


def _copies(times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row so often as ``times`` says, as (row, number of the copy) in bounded pieces."""
    ends = np.cumsum(times)
    for at in range(0, int(ends[-1]) if len(ends) else 0, COPY_ROWS):
        place = np.arange(at, min(at + COPY_ROWS, int(ends[-1])))
        row = np.searchsorted(ends, place, "right")
        yield row, place - (ends - times)[row]


def _runs(
    frame: pd.DataFrame, borders: list[np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree, the first and last string of each query's run, and its first and last block."""
    hashes = np.stack(frame["hashes"].to_numpy()) if len(frame) else np.zeros((0, 0), np.int64)
    drop = (HASH_BITS - frame["level"].to_numpy()).astype(np.int64)
    for tree in range(hashes.shape[1]):
        prefix = hashes[:, tree] >> drop
        first = (prefix << drop) << SPREAD_BITS
        last = (((prefix + 1) << drop) << SPREAD_BITS) - 1
        low = np.searchsorted(borders[tree], first, "right")
        yield tree, first, last, low, np.searchsorted(borders[tree], last, "right")


def _chunks(chosen: DataFrame, borders: list[np.ndarray]) -> list[np.ndarray]:
    """Per tree, into how many chunks the queries of each block are dealt."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, _, _, low, high in _runs(frame, borders):
                size = len(borders[tree]) + 2
                n = np.cumsum(np.bincount(low, minlength=size) - np.bincount(high + 1, minlength=size))
                block = np.flatnonzero(n)
                yield pd.DataFrame({"tree": tree, "block": block, "n": n[block]})

    counted = chosen.select("hashes", "level").mapInPandas(count, "tree int, block long, n long")
    out = [np.zeros(len(b) + 1, np.int64) for b in borders]
    # At most TREES * SAMPLE_ROWS rows.
    for r in counted.groupBy("tree", "block").agg(F.sum("n").alias("n")).collect():
        out[r["tree"]][r["block"]] = -(-r["n"] // CHUNK_QUERIES)
    return out


def _dealt(
    indexed: DataFrame, chosen: DataFrame, borders: list[np.ndarray]
) -> tuple[DataFrame, DataFrame]:
    """Points and queries of each (tree, block, chunk); a query is in one chunk of a block."""
    chunks = _chunks(chosen, borders)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = np.stack(frame["hashes"].to_numpy()) if len(frame) else np.zeros((0, 0), np.int64)
            for tree in range(hashes.shape[1]):
                strings = (hashes[:, tree] << SPREAD_BITS) | frame["spread"].to_numpy()
                block = np.searchsorted(borders[tree], strings, "right")
                for row, chunk in _copies(chunks[tree][block]):
                    yield pd.DataFrame(
                        {
                            "tree": tree,
                            "block": block[row],
                            "chunk": chunk,
                            "string": strings[row],
                            "last": np.int64(-1),
                            "id": frame["class_id"].to_numpy()[row],
                            "vector": frame["vector"].to_numpy()[row],
                        }
                    )

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, first, last, low, high in _runs(frame, borders):
                for row, nth in _copies(high - low + 1):
                    block = low[row] + nth
                    yield pd.DataFrame(
                        {
                            "tree": tree,
                            "block": block,
                            "chunk": frame["spread"].to_numpy()[row] % chunks[tree][block],
                            "string": first[row],
                            "last": last[row],
                            "id": frame["query"].to_numpy()[row],
                            "vector": frame["vector"].to_numpy()[row],
                        }
                    )

    kind = indexed.schema["vector"].dataType.simpleString()
    schema = f"tree int, block long, chunk long, string long, last long, id long, vector {kind}"

    def spread(key: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << SPREAD_BITS)).alias("spread")

    points = indexed.select("*", spread("class_id")).mapInPandas(place, schema)
    asked = chosen.select("query", "vector", "hashes", "level", spread("query")).mapInPandas(reach, schema)
    return points, asked


def _score_blocks(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, class_id, score): the best of each query in each block that it reaches."""

    def score(_key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(points) and len(asked):
            points = points.sort_values("string")
            strings, ids = points["string"].to_numpy(), points["id"].to_numpy()
            matrix = _matrix(points["vector"])
            for at in range(0, len(asked), 512):
                some = asked.iloc[at : at + 512]
                wanted = _matrix(some["vector"])
                low = np.searchsorted(strings, some["string"].to_numpy(), "left")
                high = np.searchsorted(strings, some["last"].to_numpy(), "right")
                near = wanted @ matrix.T
                inside = np.arange(len(strings))
                near[(inside < low[:, None]) | (inside >= high[:, None])] = -np.inf
                most = min(k + 1, near.shape[1])
                top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                row = np.repeat(np.arange(len(some)), most)
                flat = top.ravel()
                kept = near[row, flat] > -np.inf
                row, flat = row[kept], flat[kept]
                # The same sum for the same two vectors, whichever block they meet in.
                exact = (wanted[row] * matrix[flat]).sum(1)
                parts.append(
                    pd.DataFrame(
                        {"query": some["id"].to_numpy()[row], "class_id": ids[flat], "score": exact}
                    )
                )
        if not parts:
            return pd.DataFrame({"query": [], "class_id": [], "score": []})
        return pd.concat(parts)

    key = ["tree", "block", "chunk"]
    return (
        points.groupBy(*key)
        .cogroup(asked.groupBy(*key))
        .applyInPandas(score, "query long, class_id long, score double")
    )
