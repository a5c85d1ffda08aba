"""Square cells and skew-safe cell joins.

Spark has no spatial join, so points meet through an equi-join on cell keys. A cell may hold a large share
of all rows; ``hot_keys`` finds those (at most ``1 / share`` of them, so they always fit a broadcast) and the joins
here split their rows over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

HOT_SHARE = 1 / 512
# Rows of one key that one task of a grid join takes from either side: at most the square of it in pairs.
TASK_ROWS = 4096
# Crowded keys (a few numbers each) that are broadcast; a longer list is joined, and AQE splits what is skewed.
BROADCAST_KEYS = 65_536


def cell(value: Column, side: Column | float) -> Column:
    return F.floor(value / side).cast("bigint")


def neighbour_offsets(reach: int) -> Column:
    """All (dx, dy) with both in [-reach, reach]."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(span, lambda dx: F.transform(
        span, lambda dy: F.struct(dx.cast("bigint").alias("dx"), dy.cast("bigint").alias("dy")))))


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows, with the number of parts to split each into.

    At most ``1 / share`` keys can qualify, whatever the size of ``df``.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    total = counts.agg(F.sum("key_rows").alias("total")).scalar()
    limit = total * F.lit(share)
    return counts.filter(F.col("key_rows") > limit).select(
        *keys, F.ceil(F.col("key_rows") / limit).cast("int").alias("parts"))


def split_join(probe: DataFrame, data: DataFrame, keys: Sequence[str], spread: str, hot: DataFrame) -> DataFrame:
    """Inner equi-join where hot keys of ``data`` are split by a hash of ``spread`` and ``probe`` rows are repeated
    once per part. Both sides must name the keys alike and share no other column."""
    marked = F.broadcast(hot)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    data = data.join(marked, list(keys), "left").withColumn(
        "part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    probe = probe.join(marked, list(keys), "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return probe.join(data, [*keys, "part"]).drop("part")


def crowded_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys on both sides with more than ``rows`` rows on either, with the parts that each side is cut into."""
    counts = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a")).join(
        b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b")), list(keys))
    parts = lambda n: F.ceil(F.col(n) / F.lit(rows)).cast("int")
    return counts.filter((F.col("n_a") > rows) | (F.col("n_b") > rows)).select(
        *keys, parts("n_a").alias("parts_a"), parts("n_b").alias("parts_b"))


def in_grid(df: DataFrame, keys: Sequence[str], crowded: DataFrame, spread: Column, side: str, other: str) -> DataFrame:
    """Rows with ``part_a`` and ``part_b``: their own part by a hash, and once for each part of the other side."""
    parts = {s: F.coalesce(F.col(f"parts_{s}"), F.lit(1)) for s in (side, other)}
    return df.join(crowded, list(keys), "left").withColumn(
        f"part_{side}", F.pmod(spread, parts[side]).cast("int")).withColumn(
        f"part_{other}", F.explode(F.sequence(F.lit(0), parts[other] - 1))).drop("parts_a", "parts_b")


def grid_join(a: DataFrame, b: DataFrame, keys: Sequence[str], spread_a: Column, spread_b: Column,
              rows: int = TASK_ROWS) -> DataFrame:
    """Inner equi-join where a crowded key is a grid of ``parts_a`` x ``parts_b`` tasks.

    Each holds about ``rows`` rows of either side, however many rows the key has on both. ``spread_a`` and ``spread_b`` are
    hashes that tell rows of a key apart. Both sides must name the keys alike and share no other column.
    """
    crowded = cut(crowded_keys(a, b, keys, rows))
    n = crowded.count()
    if not n:
        return a.join(b, list(keys))
    crowded = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded
    left, right = in_grid(a, keys, crowded, spread_a, "a", "b"), in_grid(b, keys, crowded, spread_b, "b", "a")
    return left.join(right, [*keys, "part_a", "part_b"]).drop("part_a", "part_b")


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``df`` to a table with unique keys: rows of hot keys meet a broadcast of at most ``1 / share`` table rows,
    the others are shuffled."""
    hot_only = F.broadcast(hot.select(*keys))
    hot_table = F.broadcast(table.join(hot_only, list(keys), "left_semi"))
    hot_part = df.join(hot_only, list(keys), "left_semi").join(hot_table, list(keys), how)
    cold_part = df.join(hot_only, list(keys), "left_anti").join(table, list(keys), how)
    return hot_part.unionByName(cold_part)
