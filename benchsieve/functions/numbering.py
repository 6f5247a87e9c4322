"""Exact row numbers and running sums that stay spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.durable import join_null_safe, settle


def number_rows(
    df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row in ``order``, per ``group`` when given.

    Rows are sorted by range over (group, order), so a hot group or one global
    sequence covers many partitions. Rows are numbered inside their partition,
    and the rows of earlier partitions are added. ``order`` must be unique
    within a group. The sorted rows are settled, since a second sampling could
    choose other range bounds.
    """
    group = group or []
    keys = [*group, *order]
    row_id = F.monotonically_increasing_id()
    ranged = settle(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", row_id), lean=True
    ).withColumn("_part", F.shiftright("_row", 33))

    spans = ranged.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")
    )
    if not group:
        # One row per partition; row ids count up by one inside a partition.
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = spans.select(
            "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
        )
        position = F.col("_row") - F.col("_first") + F.col("_before") + 1
        return (
            ranged.join(F.broadcast(starts), "_part")
            .withColumn(name, position.cast("bigint"))
            .drop("_row", "_part", "_first", "_before")
        )

    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only the first group of a partition can have earlier rows elsewhere, so this
    # table has at most one row per partition.
    carried = (
        spans.withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before") > 0)
        .select("_part", *group, "_before")
    )
    local = Window.partitionBy("_part", *group).orderBy("_row")
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    return (
        join_null_safe(numbered, F.broadcast(carried), ["_part", *group], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_row", "_part", "_local", "_before")
    )


def running_sums(
    df: DataFrame, order: list[str], group: list[str], value: str, name: str = "before"
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the group, in ``order``.

    As ``number_rows``: sorted by range, summed inside partitions, and the sums of earlier
    partitions added, so that one group may cover many of them. ``value`` is not null.
    """
    keys = [*group, *order]
    ranged = settle(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    )
    spans = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a partition goes on from an earlier one.
    carried = spans.select("_part", *group, F.sum("_sum").over(earlier).alias("_carried")).where("_carried IS NOT NULL")
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return (
        join_null_safe(summed, F.broadcast(carried), ["_part", *group], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0)))
        .drop("_part", "_local", "_carried")
    )
