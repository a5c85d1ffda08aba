"""Planar geometry on nested arrays.

A geometry is ``ARRAY<polygon>``, a polygon ``ARRAY<ring>`` (ring 0 outer, the others holes) and a ring a closed
``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>`` whose last vertex repeats the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(ring: Column) -> Column:
    """A geometry holding one ring."""
    return F.array(F.array(ring))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))


def regular_ring(cx: Column, cy: Column, rx: Column, ry: Column, sides: int) -> Column:
    """Closed ring of ``sides`` vertices at equal angles, starting at angle zero."""
    step = 2 * math.pi / sides
    return F.transform(
        F.sequence(F.lit(0), F.lit(sides)),
        lambda k: vertex(cx + rx * F.cos(F.pmod(k, F.lit(sides)) * F.lit(step)),
                         cy + ry * F.sin(F.pmod(k, F.lit(sides)) * F.lit(step))),
    )


def hexagon(cx: Column, cy: Column, width: float) -> Column:
    """Six-vertex cell of radius ``width / 2`` around a centre."""
    radius = F.lit(width / 2)
    return polygon(regular_ring(cx, cy, radius, radius, 6))


def rings(geometry: Column) -> Column:
    return F.flatten(geometry)


def vertices(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs as ``STRUCT<x1, y1, x2, y2>``."""
    head = F.slice(ring, F.lit(1), F.size(ring) - 1)
    tail = F.slice(ring, F.lit(2), F.size(ring) - 1)
    return F.zip_with(head, tail, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def edges(geometry: Column) -> Column:
    """All edges of all rings; even-odd parity over them handles holes and parts alike."""
    return F.flatten(F.transform(rings(geometry), ring_edges))


def bounds(geometry: Column) -> dict[str, Column]:
    xs = F.transform(vertices(geometry), lambda v: v["x"])
    ys = F.transform(vertices(geometry), lambda v: v["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def strictly_inside(x: Column, y: Column, edge_array: Column) -> Column:
    """Even-odd test over an edge array; points on the boundary are outside."""

    def step(state: Column, e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        on_edge = (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )
        upward = e["y2"] > e["y1"]
        straddles = (e["y1"] > y) != (e["y2"] > y)
        right_of_point = F.when(upward, cross > 0).otherwise(cross < 0)
        return F.when(state < 0, state).when(on_edge, F.lit(-1)).when(
            straddles & right_of_point, F.lit(1) - state).otherwise(state)

    return F.aggregate(edge_array, F.lit(0), step) == 1


def _ring_moments(ring: Column) -> Column:
    """Signed area and first moments of a ring, relative to its first vertex to limit cancellation."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(s: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (s["a"] + cross / 2).alias("a"),
            (s["mx"] + (x1 + x2) * cross / 6).alias("mx"),
            (s["my"] + (y1 + y2) * cross / 6).alias("my"),
        )

    def positive(s: Column) -> Column:
        sign = F.when(s["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        a = s["a"] * sign
        return F.struct(a.alias("a"), (s["mx"] * sign + ox * a).alias("mx"), (s["my"] * sign + oy * a).alias("my"))

    return F.aggregate(ring_edges(ring), zero, step, positive)


def _moments(geometry: Column) -> Column:
    """Moments of the whole geometry: outer rings count positive, holes negative."""
    signed = F.flatten(F.transform(geometry, lambda p: F.transform(p, lambda r, i: F.struct(
        F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"), _ring_moments(r).alias("m")))))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(signed, zero, lambda s, r: F.struct(
        (s["a"] + r["sign"] * r["m"]["a"]).alias("a"),
        (s["mx"] + r["sign"] * r["m"]["mx"]).alias("mx"),
        (s["my"] + r["sign"] * r["m"]["my"]).alias("my")))


def area(geometry: Column) -> Column:
    return _moments(geometry)["a"]


def centroid(geometry: Column) -> Column:
    """Area-weighted centroid as ``STRUCT<x, y>``; NULL for zero area."""
    return F.transform(F.array(_moments(geometry)), lambda m: F.struct(
        F.try_divide(m["mx"], m["a"]).alias("x"), F.try_divide(m["my"], m["a"]).alias("y")))[0]


def to_geojson(geometry: Column) -> Column:
    """MultiPolygon struct with coordinates as nested number arrays, ready for ``to_json``."""
    coordinates = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: F.array(v["x"], v["y"]))))
    return F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))


def point_geojson(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
