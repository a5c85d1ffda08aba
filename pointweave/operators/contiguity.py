"""Neighbourhood graphs of polygons and lags over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import edges as edge_array, vertices

# Vertices closer than half of this many degrees are taken as the same.
SNAP = 1e-9


def _snapped(v: Column) -> Column:
    return F.round(v / SNAP).cast("bigint")


def _neighbours(polygons: DataFrame, id: str, key: Column) -> DataFrame:
    """Pairs of polygons sharing a key, both directions."""
    keyed = polygons.select(F.col(id).alias("src"), F.explode(F.array_distinct(key)).alias("key"))
    other = keyed.withColumnRenamed("src", "dst")
    return keyed.join(other, "key").filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def queen_neighbours(polygons: DataFrame, id: str = "GEOID", geometry: str = "geometry") -> DataFrame:
    """Polygons sharing at least a vertex: ``src, dst``."""
    return _neighbours(polygons, id, F.transform(vertices(F.col(geometry)), lambda v: F.struct(
        _snapped(v["x"]).alias("x"), _snapped(v["y"]).alias("y"))))


def rook_neighbours(polygons: DataFrame, id: str = "GEOID", geometry: str = "geometry") -> DataFrame:
    """Polygons sharing an edge: ``src, dst``."""

    def undirected(e: Column) -> Column:
        a = F.struct(_snapped(e["x1"]).alias("x"), _snapped(e["y1"]).alias("y"))
        b = F.struct(_snapped(e["x2"]).alias("x"), _snapped(e["y2"]).alias("y"))
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    return _neighbours(polygons, id, F.transform(edge_array(F.col(geometry)), undirected))


def neighbours(polygons: DataFrame, kind: str = "queen", id: str = "GEOID", geometry: str = "geometry") -> DataFrame:
    if kind not in ("queen", "rook"):
        raise ValueError(f"unknown contiguity {kind!r}")
    return (queen_neighbours if kind == "queen" else rook_neighbours)(polygons, id, geometry)


def row_standardised(edges: DataFrame) -> DataFrame:
    """Add ``w``, one over the number of neighbours of ``src``."""
    degrees = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("w"))
    return edges.join(degrees, "src")


def spatial_lag(units: DataFrame, edges: DataFrame, value: str, id: str = "GEOID", name: str = "spatial_lag") -> DataFrame:
    """Weighted mean of the neighbours' values, NULL values counting as 0; 0 for a unit without neighbours."""
    weighted = edges if "w" in edges.columns else row_standardised(edges)
    values = units.select(F.col(id).alias("dst"), F.coalesce(F.col(value), F.lit(0)).alias("x"))
    lags = weighted.join(values, "dst").groupBy(F.col("src").alias(id)).agg(F.sum(F.col("w") * F.col("x")).alias(name))
    return units.join(lags, id, "left").fillna(0.0, [name])
