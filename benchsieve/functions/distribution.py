"""Exact counts, means and medians per group, safe when one group is very large.

Counts and means are partial aggregates over the rows. For medians the same pass
finds two values per group that enclose the middle, from a sketch of bounded size.
A second pass keeps only the values between them and counts those below, so a few
percent of the rows move. The middle ranks are then read off in a sort by range over
groups and values, which spreads one hot group over many tasks.

``level_stats`` gives several levels of groups from one grouping of the rows: counts, sums
and sketches of the finest groups merge into those of the coarser ones. The second pass
reads each row once and tests it against the brackets of all its levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.durable import join_null_safe, settle

# A sketch misses a rank by at most one in ACCURACY rows, far less than the bracket is wide.
BRACKET = (0.48, 0.52)
ACCURACY = 1000
# A mergeable sketch of this size misses a rank by 0.6 percent in one of a hundred cases; the
# bracket is wider than three times that, which leaves less than 1e-15. Smaller groups are exact.
SKETCH_SIZE = 800

Columns = dict[str, tuple[str, str]]


def group_stats(
    rows: DataFrame, keys: list[str], columns: Columns, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per group; ``columns`` maps an output name to (metric, statistic).

    Statistics are ``count``, ``mean`` and ``median`` of the non-null values; ``extra``
    adds other aggregates. ``rows`` are read twice, so settle what is costly to compute.
    A group without any value of a metric has count 0 and no mean or median.
    """
    metrics = sorted({metric for metric, _ in columns.values()})
    middle = [m for m in metrics if (m, "median") in columns.values()]
    aggregates = []
    for m in metrics:
        value = F.col(m).cast("double")
        aggregates += [F.count(value).alias(f"_count_{m}"), F.avg(value).alias(f"_mean_{m}")]
        if m in middle:
            bracket = F.percentile_approx(value, list(BRACKET), ACCURACY)
            aggregates.append(bracket.alias(f"_bracket_{m}"))
    others = [column.alias(name) for name, column in (extra or {}).items()]
    stats = settle(rows.groupBy(*keys).agg(*aggregates, *others))
    wide = stats
    if middle:
        wide = join_null_safe(stats, _medians(rows, stats, keys, middle), keys, "left")
    return wide.select(
        *keys,
        *[F.col(f"_{statistic}_{m}").alias(name) for name, (m, statistic) in columns.items()],
        *(extra or {}),
    )


def _medians(rows: DataFrame, stats: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per group with ``_median_<metric>``, from the brackets in ``stats``."""
    return _middles(_counts_in_brackets(rows, stats, keys, metrics), stats, keys, metrics)


def _middles(counts: DataFrame, stats: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Medians from (keys, _metric, _value, _n); a null value counts all below the bracket."""
    group = [*keys, "_metric"]
    order = [*group, F.asc_nulls_first("_value")]
    # Settled, since a second sampling could choose other range bounds.
    ranged = settle(
        counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    total = F.coalesce(*[F.when(F.col("_metric") == m, F.col(f"_count_{m}")) for m in metrics])
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = stats.select(*keys, *[f"_count_{m}" for m in metrics])
    # One row per group and partition of the sort; the middle lies in one or two of them.
    spans = (
        ranged.groupBy(*group, "_part")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    held = (
        join_null_safe(spans, sizes, keys)
        .withColumn("_low", F.floor((total + 1) / 2))
        .withColumn("_high", F.floor((total + 2) / 2))
        .where(
            (F.col("_before") < F.col("_high"))
            & (F.col("_before") + F.col("_rows") >= F.col("_low"))
        )
        .select(*group, "_part", "_before", "_low", "_high")
    )
    inside = Window.partitionBy(*group, "_part").orderBy(F.asc_nulls_first("_value"))
    last = F.col("_last")

    def at(rank: str) -> Column:
        first = last - F.col("_n")
        return F.max(F.when((first < F.col(rank)) & (F.col(rank) <= last), F.col("_value")))

    medians = (
        join_null_safe(ranged, held, [*group, "_part"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(inside))
        .groupBy(*group)
        .agg(((at("_low") + at("_high")) / 2).alias("_median"))
    )
    return medians.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_metric") == m, F.col("_median"))).alias(f"_median_{m}")
            for m in metrics
        ]
    )


def level_stats(
    rows: DataFrame, keys: list[str], levels: list[Column], level_keys: list[str], columns: Columns
) -> DataFrame:
    """``group_stats`` of several levels: one row per group of each level.

    ``keys`` are those of the finest groups. ``levels`` make of them the structs of
    ``level_keys``, one for each level. ``rows`` are read three times, so settle what is costly
    to compute.
    """
    metrics = sorted({metric for metric, _ in columns.values()})
    middle = [m for m in metrics if (m, "median") in columns.values()]
    fine, coarse = [], []
    for m in metrics:
        value = F.col(m).cast("double")
        fine += [F.count(value).alias(f"_count_{m}"), F.sum(value).alias(f"_sum_{m}")]
        coarse += [F.sum(f"_count_{m}").alias(f"_count_{m}"), F.sum(f"_sum_{m}").alias(f"_sum_{m}")]
        if m in middle:
            fine.append(F.kll_sketch_agg_double(value, SKETCH_SIZE).alias(f"_sketch_{m}"))
            coarse.append(F.kll_merge_agg_double(f"_sketch_{m}", SKETCH_SIZE).alias(f"_sketch_{m}"))
    states = settle(rows.groupBy(*keys).agg(*fine))
    leveled = states.withColumn("_levels", F.array(*levels))
    carried = [c for c in states.columns if c.startswith(("_count_", "_sum_", "_sketch_"))]
    merged = leveled.select(*carried, F.inline("_levels")).groupBy(*level_keys).agg(*coarse)

    def bracket(m: str) -> Column:
        sketch = F.col(f"_sketch_{m}")
        ends = [F.kll_sketch_get_quantile_double(sketch, F.lit(rank)) for rank in BRACKET]
        return F.when(F.col(f"_count_{m}") > 0, F.array(*ends)).alias(f"_bracket_{m}")

    means = [F.try_divide(f"_sum_{m}", f"_count_{m}").alias(f"_mean_{m}") for m in metrics]
    stats = settle(
        merged.select(*level_keys, *[f"_count_{m}" for m in metrics], *means, *[bracket(m) for m in middle])
    )
    wide = stats
    if middle:
        counts = _counts_by_level(rows, leveled, stats, keys, level_keys, middle, len(levels))
        wide = join_null_safe(stats, _middles(counts, stats, level_keys, middle), level_keys, "left")
    return wide.select(
        *level_keys, *[F.col(f"_{statistic}_{m}").alias(name) for name, (m, statistic) in columns.items()]
    )


def _counts_by_level(
    rows: DataFrame,
    leveled: DataFrame,
    stats: DataFrame,
    keys: list[str],
    level_keys: list[str],
    metrics: list[str],
    n_levels: int,
) -> DataFrame:
    """(level keys, _metric, _value, _n): values in their brackets, and a null for all below.

    Each finest group carries the brackets of its levels, so a row meets them in one join.
    """
    brackets = [f"_bracket_{m}" for m in metrics]
    # Keys of the finest groups are in one column here, since levels may have keys of their names.
    each = leveled.select(F.struct(*keys).alias("_fine"), F.posexplode("_levels").alias("_at", "_level"))
    found = join_null_safe(each.select("_fine", "_at", "_level.*"), stats.select(*level_keys, *brackets), level_keys)
    held = F.array_sort(F.collect_list(F.struct("_at", *level_keys, *brackets)))
    # As many entries as there are levels.
    lookup = settle(found.groupBy("_fine").agg(held.alias("_held")).select("_fine.*", "_held"))
    values = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    met = join_null_safe(values, lookup, keys)

    def end(level: int, m: str, which: int) -> Column:
        return F.get(F.col("_held")[level][f"_bracket_{m}"], F.lit(which))

    below = [
        F.count_if(F.col(m) < end(k, m, 0)).alias(f"_below_{k}_{m}") for k in range(n_levels) for m in metrics
    ]
    entries = [
        F.when(
            (F.col(m) >= end(k, m, 0)) & (F.col(m) <= end(k, m, 1)),
            F.struct(*[F.col("_held")[k][c].alias(c) for c in level_keys], F.lit(m).alias("_metric"), F.col(m).alias("_value")),
        )
        for k in range(n_levels)
        for m in metrics
    ]
    group = [*level_keys, "_metric", "_value"]
    inside = met.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    inside = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    summed = join_null_safe(met.groupBy(*keys).agg(*below), lookup, keys)
    under = [
        F.struct(
            *[F.col("_held")[k][c].alias(c) for c in level_keys],
            F.lit(m).alias("_metric"),
            F.lit(None).cast("double").alias("_value"),
            F.col(f"_below_{k}_{m}").alias("_n"),
        )
        for k in range(n_levels)
        for m in metrics
    ]
    under = summed.select(F.inline(F.array(*under))).where(F.col("_n") > 0)
    under = under.groupBy(*group).agg(F.sum("_n").alias("_n"))
    return inside.unionByName(under)


def _counts_in_brackets(
    rows: DataFrame, stats: DataFrame, keys: list[str], metrics: list[str]
) -> DataFrame:
    """(keys, _metric, _value, _n) for values in their bracket; a null counts all below it."""
    brackets = stats.select(*keys, *[f"_bracket_{m}" for m in metrics])
    values = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])

    def entry(m: str) -> Column:
        low, high = F.get(f"_bracket_{m}", F.lit(0)), F.get(f"_bracket_{m}", F.lit(1))
        value = F.when(F.col(m) >= low, F.col(m))
        return F.when(
            F.col(m) <= high, F.struct(F.lit(m).alias("_metric"), value.alias("_value"))
        )

    entries = F.filter(F.array(*[entry(m) for m in metrics]), lambda e: e.isNotNull())
    return (
        join_null_safe(values, brackets, keys)
        .select(*keys, F.inline(entries))
        .groupBy(*keys, "_metric", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
