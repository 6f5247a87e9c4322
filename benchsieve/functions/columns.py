"""Placing of expressions and rows in a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set columns so that a later filter tests their values.

    A filter on plain projected columns is pushed below the projection and
    repeats every expression there. A generator with one row keeps it above.
    """
    rest = [c for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*rest, F.inline(F.array(values)))


SPREAD = 32


def spread_scan(scan: DataFrame) -> DataFrame:
    """Spread a source of few partitions over the cores before costly expressions.

    Large sources have more partitions than the cluster has cores and stay as they
    are. A partition is split into at most ``SPREAD`` parts. Only for plain scans:
    asking for the partitions of other plans could run a part of them.
    """
    partitions = scan.rdd.getNumPartitions()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if partitions >= cores:
        return scan
    return scan.repartition(min(cores, partitions * SPREAD))
