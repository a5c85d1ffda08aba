"""Bounded blocks of nearby points.

Points are range-partitioned along a Z-order curve and packed into rows of at most ``size`` points with a tight box.
Whatever the skew, a block is small, so pairs of blocks can be worked on in vectorised tasks of bounded memory:
a crowded place simply has more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import one_row
from ..session import cut

BLOCK_POINTS = 2048
# Block boxes (five numbers each) held by every task up to this many.
SMALL_BOXES = 4096
# Partners of one block that are kept together when pairs are spread by block and ``part``.
PARTNERS_PER_TASK = 64
_CURVE_BITS = 31
# Masks that space out the bits of a 31-bit number, one per doubling step.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
           (1, 0x5555555555555555))


def with_curve_position(df: DataFrame, x: str, y: str, name: str = "z") -> DataFrame:
    """Add the Z-order position of each point within the bounds of ``df``.

    Every bit-spreading step is a column of its own: nested in one expression they would double at each step.
    """
    b = one_row(df, x0=F.min(x), x1=F.max(x), y0=F.min(y), y1=F.max(y))
    top = float(2**_CURVE_BITS - 1)

    def scaled(v: str, lo: str, hi: str) -> Column:
        width = b[hi] - b[lo]
        share = F.when(width > 0, (F.col(v) - b[lo]) / width).otherwise(F.lit(0.0))
        return F.least(F.greatest(share, F.lit(0.0)) * top, F.lit(top)).cast("bigint")

    df = df.withColumns({"zx": scaled(x, "x0", "x1"), "zy": scaled(y, "y0", "y1")})
    for shift, mask in _SPREAD:
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
                             for c in ("zx", "zy")})
    return df.withColumn(name, F.col("zx").bitwiseOR(F.shiftleft("zy", 1))).drop("zx", "zy")


def point_blocks(df: DataFrame, x: str, y: str, carry: str, size: int = BLOCK_POINTS) -> DataFrame:
    """Blocks with columns box_id, min_x, min_y, max_x, max_y, n, xs, ys, carried.

    ``carry`` is the one further column kept per point (an id or a weight). Sorting by it as well lets the range
    partitioning split points that share one location. The result is written out, so block ids stay fixed.
    """
    carried_type = df.schema[carry].dataType
    named = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(carry).alias("carried"))
    ordered = (with_curve_position(named, "x", "y").repartitionByRange("z", "carried")
               .sortWithinPartitions("z", "carried").drop("z"))
    schema = T.StructType([
        T.StructField("box_id", T.LongType()), T.StructField("min_x", T.DoubleType()),
        T.StructField("min_y", T.DoubleType()), T.StructField("max_x", T.DoubleType()),
        T.StructField("max_y", T.DoubleType()), T.StructField("n", T.LongType()),
        T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType())),
        T.StructField("carried", T.ArrayType(carried_type)),
    ])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 33
        made, rest = 0, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            whole = len(rest) // size * size
            if whole:
                yield _as_blocks(rest.iloc[:whole], base + made, size)
                made += whole // size
                rest = rest.iloc[whole:]
        if rest is not None and len(rest):
            yield _as_blocks(rest, base + made, size)

    return cut(ordered.mapInPandas(pack, schema))


def _as_blocks(points: pd.DataFrame, first_id: int, size: int) -> pd.DataFrame:
    xs, ys, carried = (points[c].to_numpy() for c in ("x", "y", "carried"))
    starts = np.arange(0, len(xs), size)
    parts = [slice(s, s + size) for s in starts]
    return pd.DataFrame({
        "box_id": first_id + np.arange(len(parts), dtype="int64"),
        "min_x": [xs[p].min() for p in parts], "min_y": [ys[p].min() for p in parts],
        "max_x": [xs[p].max() for p in parts], "max_y": [ys[p].max() for p in parts],
        "n": [len(xs[p]) for p in parts],
        "xs": [xs[p] for p in parts], "ys": [ys[p] for p in parts], "carried": [carried[p] for p in parts],
    })


def task_count(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
