"""Hexagonal and rectangular binning, and tests against complete spatial randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import one_row, squared_distance
from ..functions.geometry import hexagon, rectangle
from ..functions.special import chi_square_p


def _hex_centre(col: Column, row: Column, width: float) -> tuple[Column, Column]:
    """Centre of a cell; odd rows are shifted by half a width."""
    shift = F.when(F.pmod(row, F.lit(2)) == 1, F.lit(width / 2)).otherwise(F.lit(0.0))
    return col * F.lit(width) + shift, row * F.lit(width * math.sqrt(3) / 2)


def hex_cell(lon: Column, lat: Column, cell_size: float, mode: str = "reference") -> tuple[Column, Column]:
    """Column and row of a point. ``reference`` rounds each axis; ``nearest`` takes the closest drawn centre."""
    height = cell_size * math.sqrt(3) / 2
    if mode == "reference":
        return F.rint(lon / F.lit(cell_size)).cast("bigint"), F.rint(lat / F.lit(height)).cast("bigint")
    if mode != "nearest":
        raise ValueError(f"unknown mode {mode!r}")
    base = F.floor(lat / F.lit(height))

    def candidate(row: Column) -> Column:
        shift = F.when(F.pmod(row, F.lit(2)) == 1, F.lit(cell_size / 2)).otherwise(F.lit(0.0))
        col = F.rint((lon - shift) / F.lit(cell_size)).cast("bigint")
        cx, cy = _hex_centre(col, row, cell_size)
        return F.struct(squared_distance(lon, lat, cx, cy).alias("gap"), col.alias("col"), row.alias("row"))

    best = F.least(candidate(base), candidate(base + 1))
    return best["col"], best["row"]


def hexbins(df: DataFrame, lon: str = "longitude", lat: str = "latitude", cell_size: float = 0.25,
            mode: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """Incidents per occupied hexagon (and per ``by`` value) with the drawn polygon."""
    col, row = hex_cell(F.col(lon), F.col(lat), cell_size, mode)
    counts = df.groupBy(col.alias("hex_col"), row.alias("hex_row"), *by).agg(F.count(F.lit(1)).alias("count"))
    cx, cy = _hex_centre(F.col("hex_col"), F.col("hex_row"), cell_size)
    return counts.withColumn("geometry", hexagon(cx, cy, cell_size))


def square_cells(df: DataFrame, side: float, lon: str = "longitude", lat: str = "latitude",
                 count: str = "offense_count") -> DataFrame:
    """Occupied square cells with their count and rectangle; corners of neighbours are bit-equal."""
    cells = df.groupBy(F.floor(F.col(lon) / side).alias("cx"), F.floor(F.col(lat) / side).alias("cy")).agg(
        F.count(F.lit(1)).alias(count))
    corner = [F.col("cx") * side, F.col("cy") * side, (F.col("cx") + 1) * side, (F.col("cy") + 1) * side]
    return cells.withColumn("geometry", rectangle(*corner))


def _edge(i: Column, lo: Column, hi: Column, n: int) -> Column:
    return F.when(i == n, hi).otherwise(i * ((hi - lo) / F.lit(float(n))) + lo)


def _bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of ``v`` among ``n`` equal ones, the last closed on the right; agrees with the edges as computed."""
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - lo) / (hi - lo) * n)))
    return (F.when((guess > 0) & (v < _edge(guess, lo, hi, n)), guess - 1)
            .when((guess < n - 1) & (v >= _edge(guess + 1, lo, hi, n)), guess + 1).otherwise(guess)).cast("int")


def quadrats(df: DataFrame, lon: str = "longitude", lat: str = "latitude", n_cols: int = 20, n_rows: int = 20) -> DataFrame:
    """Counts on a regular grid over the data bounds, empty cells included: ``col, row, count, geometry``."""
    b = one_row(df, x0=F.min(lon), x1=F.max(lon), y0=F.min(lat), y1=F.max(lat))
    x, y = (b["x0"], b["x1"]), (b["y0"], b["y1"])
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    counts = located.groupBy(_bin(F.col(lon), *x, n_cols).alias("col"), _bin(F.col(lat), *y, n_rows).alias("row")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(n_cols * n_rows).select(
        F.expr(f"id div {n_rows}").cast("int").alias("col"), F.expr(f"id % {n_rows}").cast("int").alias("row"))
    col, row = F.col("col"), F.col("row")
    return grid.join(counts, ["col", "row"], "left").fillna(0, ["count"]).withColumn("geometry", rectangle(
        _edge(col, *x, n_cols), _edge(row, *y, n_rows), _edge(col + 1, *x, n_cols), _edge(row + 1, *y, n_rows)))


def quadrat_statistics(cells: DataFrame, count: str = "count") -> DataFrame:
    """Chi-square statistic against equal counts, its p-value, and the variance-to-mean ratio of the cells."""
    c = F.col(count).cast("double")
    base = cells.agg(F.sum(c * c).alias("sq"), F.sum(c).alias("total"), F.count(c).cast("double").alias("cells"))
    mean = F.col("total") / F.col("cells")
    deviation = F.col("sq") - F.col("total") * mean
    table = base.select(
        (deviation / (mean + 1e-9)).alias("chi2_stat"), (F.col("cells") - 1).alias("dof"),
        F.when(mean > 0, F.try_divide(deviation / F.col("cells"), mean)).otherwise(F.lit(0.0)).alias("vmr"))
    return table.select("chi2_stat", chi_square_p("chi2_stat", "dof").alias("chi2_p"), "vmr")
