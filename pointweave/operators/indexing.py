"""Dense 0-based numbering of a large table in sort order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

_ROW_BITS = 33


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add ``name``: the position of each row by ``order``.

    The distributed sort numbers rows inside each partition; the offsets come from one count per partition. The sorted
    table is written out first, so both steps see the same partitions.
    """
    marked = cut(df.orderBy(order).withColumn("row_mark", F.monotonically_increasing_id()))
    part = F.shiftright("row_mark", _ROW_BITS).alias("row_part")
    sizes = marked.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("row_part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.col("row_mark").bitwiseAND(F.lit(2**_ROW_BITS - 1).cast("bigint"))
    # One offset row per partition of the sort.
    return (marked.withColumn("row_part", part).join(F.broadcast(offsets), "row_part")
            .withColumn(name, F.col("offset") + inside).drop("row_mark", "row_part", "offset"))
