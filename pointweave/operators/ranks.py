"""Exact ranks and percentiles of large columns.

Distinct values are counted first (with map-side combining), and the counts are written once, in slices by ranges of group
and value. Cumulative counts come from one small table of slice totals plus a window inside each slice, so no task sorts a
whole group, and several columns are several groups of the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut


def cumulative_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: ``rows``, rows ``below`` it and group ``total``. NULL values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("rows"))
    return accumulated(counts, groups, value)


def accumulated(counts: DataFrame, groups: Sequence[str], value: str, keep: Sequence[str] = ()) -> DataFrame:
    """``cumulative_counts`` of a table that has one row with its ``rows`` per group and value already; ``keep`` are further
    columns of it."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(counts.repartitionByRange(n, *groups, value).withColumn("slice", F.spark_partition_id()))
    totals = sliced.groupBy(*groups, "slice").agg(F.sum("rows").alias("slice_rows"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = by_group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group in each slice: at most the groups and the slices together.
    totals = totals.select(*groups, "slice", F.coalesce(F.sum("slice_rows").over(earlier), F.lit(0)).alias("before"),
                           F.sum("slice_rows").over(by_group).alias("total"))
    inside = Window.partitionBy("slice", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # Groups are compared null-safely, as a null group is a group.
    renamed = totals.withColumnsRenamed({g: f"__{g}" for g in groups}).withColumnRenamed("slice", "__slice")
    on = F.col("slice") == F.col("__slice")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    within = sliced.withColumn("within", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    return within.join(renamed, on).select(*groups, value, "rows", (F.col("before") + F.col("within")).alias("below"), "total", *keep)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of the places they take."""
    ranks = cumulative_counts(df, [], value)
    return ranks.select(value, (F.col("below") + (F.col("rows") + 1) / 2).alias("average_rank"))


def _interpolated(p: Column, value: str) -> Column:
    """Linear interpolation between the two order statistics around position p * (total - 1)."""
    place = p * (F.col("total") - 1)
    low = F.floor(place)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("rows")), F.col(value)))

    lower, upper = at(low), at(F.least(low + 1, F.col("total") - 1))
    share = F.max(place - low)
    return lower + (upper - lower) * share


def grouped_percentiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact percentiles per group: ``groups, probability, percentile``."""
    ranks = cumulative_counts(df, groups, value)
    columns = [_interpolated(F.lit(p), value).alias(f"p{i}") for i, p in enumerate(probabilities)]
    wide = ranks.groupBy(*groups).agg(*columns)
    entries = F.array(*[F.struct(F.lit(p).alias("probability"), F.col(f"p{i}").alias("percentile"))
                        for i, p in enumerate(probabilities)])
    return wide.select(*groups, F.inline(entries))


def percentiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    return grouped_percentiles(df, [], value, probabilities)
