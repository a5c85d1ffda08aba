"""Convex hulls of clusters, built as hulls of hulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import polygon, regular_ring

# Tasks a cluster's partial hulls are spread over before the last merge.
HULL_PARTS = 512
# Segments of the circle drawn for clusters with fewer than three points.
CIRCLE_SIDES = 64


def convex_hull(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Corner points in counter-clockwise order, by the monotone chain method."""
    points = np.unique(np.column_stack([xs, ys]), axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in rows:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull corners per cluster and batch: all that can matter later."""
    for batch in batches:
        for label, rows in batch.groupby("label"):
            corners = convex_hull(rows["x"].to_numpy(), rows["y"].to_numpy())
            yield pd.DataFrame({"label": label, "x": corners[:, 0], "y": corners[:, 1]})


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    corners = convex_hull(group["x"].to_numpy(), group["y"].to_numpy())
    return pd.DataFrame({"label": group["label"].iloc[0], "x": corners[:, 0], "y": corners[:, 1]})


def _ring(group: pd.DataFrame) -> pd.DataFrame:
    corners = convex_hull(group["x"].to_numpy(), group["y"].to_numpy())
    # Fewer than three corners (points in one place or on one line) enclose nothing.
    ring = [{"x": float(px), "y": float(py)} for px, py in [*corners, corners[0]]] if len(corners) > 2 else None
    return pd.DataFrame({"label": [group["label"].iloc[0]], "ring": [ring]})


def cluster_hulls(labelled: DataFrame, eps: float = 0.05, x: str = "longitude", y: str = "latitude",
                  label: str = "cluster_id") -> DataFrame:
    """``cluster_id, size, centroid_lon, centroid_lat, geometry`` per cluster; a circle of radius ``eps`` around the
    first point (smallest coordinates) below three hull corners, so for points on one line too.

    Batches shrink to their hull corners where they are read, then a cluster's corners are merged in HULL_PARTS
    groups and once more, so a cluster holding most of the rows never meets in one task.
    """
    points = labelled.filter(F.col(label) >= 0).select(F.col(label).alias("label"), F.col(x).alias("x"), F.col(y).alias("y"))
    corner = "label bigint, x double, y double"
    partial = points.mapInPandas(_partial_hulls, corner)
    spread = partial.groupBy("label", F.pmod(F.xxhash64("x", "y"), F.lit(HULL_PARTS)).alias("part")).applyInPandas(
        _merged, corner)
    rings = spread.groupBy("label").applyInPandas(_ring, "label bigint, ring array<struct<x:double,y:double>>")
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("centroid_lon"),
                                        F.avg("y").alias("centroid_lat"), F.min(F.struct("x", "y")).alias("first"))
    radius = F.lit(float(eps))
    circle = regular_ring(F.col("first.x"), F.col("first.y"), radius, radius, CIRCLE_SIDES)
    return sizes.join(rings, "label").select(
        F.col("label").alias(label), "size", "centroid_lon", "centroid_lat",
        polygon(F.coalesce(F.col("ring"), circle)).alias("geometry"))
