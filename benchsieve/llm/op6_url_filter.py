"""URL rules by a sort-merge range join.

A host's labels in reverse order make a key under which a rule's host and all its subdomains
form one interval. URLs and rules are sorted by that key over all partitions. A sweep through
a partition keeps a stack of the rules whose intervals hold the current key; intervals nest or
are disjoint, so a rule leaves the stack when a key does not begin with its own. Rules that
reach into a partition from an earlier one are looked up by the beginnings of its first key.

Among the rules on the stack whose path begins the URL's path, the longest wins (host and path
together, then the host). A null URL or one without ``://`` has an empty host and path and fits
no rule; neither do rules with a null or empty host. Of equal rules the one with the first
verdict counts. Repeated rows are judged one by one. Empty tables of pages give an empty
result; without rules the verdict is the default. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE, _URL = 0, 1


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """a.example.net becomes net.example.a. so that subdomains follow their domain."""
    return F.when(
        host != "", F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))
    ).otherwise(F.lit(""))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, list[tuple[int, int, str, str, str]]]] = []
    part = None
    for batch in batches:
        cols = batch.to_pydict()
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        for i, key in enumerate(cols["key"]):
            if cols["part"][i] != part:
                part, stack = cols["part"][i], []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            host, path = cols["host"][i], cols["path"][i]
            if cols["kind"][i] == _RULE:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                rank = (len(host) + len(path), len(host))
                stack[-1][1].append((*rank, path, host + path, cols["verdict"][i]))
                continue
            fits = [r for _, rules in stack for r in rules if path.startswith(r[2])]
            best = max(fits, key=lambda r: r[:2], default=None)
            out["page_id"].append(cols["page_id"][i])
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(best[3] if best else None)
            out["verdict"].append(best[4] if best else None)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["page_id"], batch.schema.field("page_id").type),
                *[pa.array(out[c], pa.string()) for c in ("host", "path", "rule", "verdict")],
            ],
            list(out),
        )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of ``pages`` (page_id, url).

    ``rules`` have host, path and verdict, and may be many; no rule is sent to all tasks.
    """
    id_type = pages.schema["page_id"].dataType
    urls = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).select(
        host_key(F.col("host")).alias("key"),
        F.lit(_URL).alias("kind"),
        "host",
        "path",
        "page_id",
        F.lit(None).cast("string").alias("verdict"),
    )
    host = F.translate(F.col("host"), UPPER, LOWER)
    known = (
        rules.where(host != "")
        .groupBy(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.min("verdict").alias("verdict"))
        .select(
            host_key(F.col("host")).alias("key"),
            F.lit(_RULE).alias("kind"),
            "host",
            "path",
            F.lit(None).cast(id_type).alias("page_id"),
            "verdict",
        )
    )
    order = ["key", "kind", "path", "page_id"]
    ranged = settle(
        urls.unionByName(known).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    labels = F.split(F.col("key"), r"\.")
    starts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda n: F.concat(F.concat_ws(".", F.slice(labels, 1, n)), F.lit(".")),
    )
    # One row per partition and label of its first key.
    first = ranged.groupBy("part").agg(F.min("key").alias("key"))
    reaching = first.select("part", F.explode(starts).alias("key")).join(known, "key")
    swept = (
        ranged.unionByName(reaching.select(ranged.columns))
        .repartition("part")
        .sortWithinPartitions("part", *order)
        .select("part", *order, "host", "verdict")
        .mapInArrow(
            _sweep,
            f"page_id {id_type.simpleString()}, host string, path string, rule string, verdict string",
        )
    )
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
