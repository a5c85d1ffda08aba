"""Gaussian kernel density surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import linspace
from .blocks import with_curve_position
from .ranks import percentiles

PAD = 0.05
# Kernel exponent below which a double is exactly zero.
_UNDERFLOW = 745.0
# Half extent of a group of points summed by one matrix product, in bandwidths.
_GROUP_SPAN = 2.0


def kernel_density(df: DataFrame, lon: str = "longitude", lat: str = "latitude", grid_size: int = 300,
                   bandwidth: float | None = None) -> DataFrame:
    """Density on a ``grid_size`` squared grid over the padded bounds: ``gx, gy, lon, lat, density``.

    The kernel covariance is the sample covariance times the squared factor, n^(-1/6) unless ``bandwidth`` is given.
    Each task adds up its points on its own grid and emits the cells it reached; nothing of size points x grid exists.
    """
    points = df.select(F.col(lon).alias("x"), F.col(lat).alias("y")).dropna()
    s = points.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                   F.max("y").alias("y1"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"),
                   F.covar_samp("x", "y").alias("xy"), F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    if s["n"] < 3 or s["xx"] * s["yy"] - s["xy"] ** 2 <= 0:
        raise ValueError("kernel density needs at least three points that are not on one line")
    factor = bandwidth if bandwidth is not None else s["n"] ** (-1 / 6)
    covariance = np.array([[s["xx"], s["xy"]], [s["xy"], s["yy"]]]) * factor**2
    precision = np.linalg.inv(covariance)
    norm = 1 / (s["n"] * 2 * np.pi * np.sqrt(np.linalg.det(covariance)))
    pad_x, pad_y = (s["x1"] - s["x0"]) * PAD, (s["y1"] - s["y0"]) * PAD
    box = (s["x0"] - pad_x, s["x1"] + pad_x, s["y0"] - pad_y, s["y1"] + pad_y)
    grid_x, grid_y = np.linspace(box[0], box[1], grid_size), np.linspace(box[2], box[3], grid_size)
    scale = np.sqrt(np.diag(covariance))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surface = np.zeros((grid_size, grid_size))
        for batch in batches:
            _add_points(surface, batch["x"].to_numpy(), batch["y"].to_numpy(), batch["w"].to_numpy(float),
                        grid_x, grid_y, precision, scale)
        gx, gy = np.nonzero(surface)
        yield pd.DataFrame({"gx": gx, "gy": gy, "part": surface[gx, gy]})

    # Equal locations are summed once; along the curve a batch covers a small area, which the products below need.
    weighted = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ordered = with_curve_position(weighted, "x", "y").repartitionByRange("z", "x").sortWithinPartitions("z").drop("z")
    parts = ordered.mapInPandas(add_up, "gx int, gy int, part double")
    summed = parts.groupBy("gx", "gy").agg((F.sum("part") * F.lit(float(norm))).alias("density"))
    grid = df.sparkSession.range(grid_size * grid_size).select(
        F.expr(f"id % {grid_size}").cast("int").alias("gx"), F.expr(f"id div {grid_size}").cast("int").alias("gy"))
    lo_x, hi_x, lo_y, hi_y = (F.lit(float(v)) for v in box)
    return grid.join(summed, ["gx", "gy"], "left").select(
        "gx", "gy", linspace(F.col("gx"), lo_x, hi_x, grid_size).alias("lon"),
        linspace(F.col("gy"), lo_y, hi_y, grid_size).alias("lat"), F.coalesce("density", F.lit(0.0)).alias("density"))


def _add_points(surface: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, grid_x: np.ndarray,
                grid_y: np.ndarray, precision: np.ndarray, scale: np.ndarray) -> None:
    """Add the kernels of a batch of points to a surface.

    For points within a small group, with offsets e from its centre and grid offsets g, the quadratic form splits
    into Q(g) - 2 B(g, e) + Q(e), and B is a sum of an x part and a y part. So a group adds exp(-Q(g)/2) times one
    matrix product of exp(gx s) and exp(gy t): two small tables of exponentials instead of one per point and cell.
    """
    (a, b), (_, c) = precision
    # Correlated axes make the two parts of B grow against each other; smaller groups keep them in range.
    span = min(_GROUP_SPAN, 6 * (1 - abs(b) / np.sqrt(a * c)))
    if span < 0.2:
        _add_points_directly(surface, x, y, w, grid_x, grid_y, precision)
        return
    cells = pd.DataFrame({"i": np.floor(x / (span * scale[0])), "j": np.floor(y / (span * scale[1]))})
    for rows in cells.groupby(["i", "j"]).indices.values():
        cx, cy = x[rows].mean(), y[rows].mean()
        ex, ey = x[rows] - cx, y[rows] - cy
        # Marginal reach: beyond it the kernel of every point of the group is zero in double precision.
        reach = np.sqrt(2 * _UNDERFLOW) + span
        ix = np.flatnonzero(np.abs(grid_x - cx) <= reach * scale[0])
        iy = np.flatnonzero(np.abs(grid_y - cy) <= reach * scale[1])
        if not len(ix) or not len(iy):
            continue
        gx, gy = grid_x[ix] - cx, grid_y[iy] - cy
        s, t = a * ex + b * ey, b * ex + c * ey
        own = w[rows] * np.exp(-(a * ex * ex + 2 * b * ex * ey + c * ey * ey) / 2)
        quadratic = (a * gx * gx)[:, None] + 2 * b * gx[:, None] * gy[None, :] + (c * gy * gy)[None, :]
        # Exponents near the caps only occur where the leading factor is below 1e-100.
        left = np.exp(np.clip(np.outer(gx, s), -300, 300))
        right = np.exp(np.clip(np.outer(t, gy), -300, 300))
        add = np.exp(-quadratic / 2) * ((left * own) @ right)
        surface[np.ix_(ix, iy)] += add


def _add_points_directly(surface: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, grid_x: np.ndarray,
                         grid_y: np.ndarray, precision: np.ndarray) -> None:
    """One exponential per point and grid cell, for nearly collinear data."""
    (a, b), (_, c) = precision
    for px, py, pw in zip(x, y, w):
        dx, dy = grid_x - px, grid_y - py
        form = (a * dx * dx)[:, None] + 2 * b * dx[:, None] * dy[None, :] + (c * dy * dy)[None, :]
        surface += pw * np.exp(-form / 2)


def with_hotspots(surface: DataFrame, percentile: float = 90.0) -> DataFrame:
    """Mark cells whose density reaches the (linearly interpolated) percentile of all cells."""
    bar = percentiles(surface, "density", [percentile / 100]).select("percentile").scalar()
    return surface.withColumn("is_hotspot", F.col("density") >= bar)


def density_summary(df: DataFrame, surface: DataFrame, percentile: float = 90.0, lon: str = "longitude",
                    bandwidth: float | None = None) -> DataFrame:
    """One row: ``bandwidth, n_points, hotspot_threshold``."""
    n = F.count(lon)
    factor = F.lit(float(bandwidth)) if bandwidth is not None else F.pow(n.cast("double"), F.lit(-1 / 6))
    threshold = percentiles(surface, "density", [percentile / 100]).select("percentile").scalar()
    return df.agg(factor.alias("bandwidth"), n.alias("n_points")).withColumn("hotspot_threshold", threshold)
