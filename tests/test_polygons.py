import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import cells, joins, polygon_index


def edges_of(rings):
    return np.array([(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])], float)


def brute_inside(e, x, y):
    """Even-odd with a ray to the right; points on an edge are outside."""
    ax, ay, bx, by = e.T
    side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (side == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
    crossed = ((ay > y) != (by > y)) & np.where(by > ay, side > 0, side < 0)
    return bool(crossed.sum() % 2) and not on.any()


def brute_inside_all(e, xs, ys):
    """``brute_inside`` for all points that lie in the polygon's box."""
    out = np.zeros(len(xs), bool)
    low, high = np.minimum(e[:, :2], e[:, 2:]).min(0), np.maximum(e[:, :2], e[:, 2:]).max(0)
    for i in np.flatnonzero((xs >= low[0]) & (xs <= high[0]) & (ys >= low[1]) & (ys <= high[1])):
        out[i] = brute_inside(e, xs[i], ys[i])
    return out


def lattice_rings(random, n):
    """Rings over few whole numbers: vertices on cell corners, edges along borders, crossings, doubled edges."""
    return [[tuple(map(float, random.integers(-6, 7, 2))) for _ in range(random.integers(3, n))] for _ in range(random.integers(1, 4))]


@pytest.mark.parametrize("seed", range(40))
def test_cells_hold_what_decides(seed):
    random = np.random.default_rng(seed)
    e = edges_of(lattice_rings(random, 12))
    parts = list(polygon_index.cut_polygon(e, most=1 + seed % 4))
    points = [*(random.integers(-14, 15, (150, 2)) / 2), *random.uniform(-7, 7, (150, 2))]
    for x, y in points:
        held = [p for p in parts if math.floor(x * 2.0 ** p[0]) == p[1] and math.floor(y * 2.0 ** p[0]) == p[2]]
        assert len(held) <= 1
        found = False
        if held:
            level, cx, cy, corner, own = held[0]
            side = 2.0**-level
            flips = polygon_index._crossed(own, x, y, (cx + 1) * side, cy * side) if len(own) else 0
            on = len(own) and not brute_inside(e, x, y) and on_some_edge(own, x, y)
            found = bool(corner ^ flips) and not on
        assert found == brute_inside(e, x, y), (x, y)


def on_some_edge(e, x, y):
    ax, ay, bx, by = e.T
    side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    return ((side == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y)
            & (y <= np.maximum(ay, by))).any()


def star(n, cx, cy, r, depth=0.001):
    radius = [r * (1 - depth * (i % 2)) for i in range(n)]
    return [(cx + radius[i] * math.cos(2 * math.pi * i / n), cy + radius[i] * math.sin(2 * math.pi * i / n)) for i in range(n)]


def as_geometry(rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in rings]]


def test_index_grows_with_edges_not_with_area():
    rows = {n: sum(1 + len(own) for *_, own in polygon_index.cut_polygon(edges_of([star(n, 0, 0, 5)]))) for n in (2000, 20_000)}
    assert rows[20_000] < 15 * rows[2000] and rows[20_000] < 4 * 20_000
    spikes = list(polygon_index.cut_polygon(edges_of([star(5000, 0, 0, 5, 0.5)])))
    assert sum(1 + len(own) for *_, own in spikes) < 10 * 5000
    small = sum(1 + len(own) for *_, own in polygon_index.cut_polygon(edges_of([[(0, 0), (1e-4, 0), (1e-4, 1e-4), (0, 1e-4)]])))
    assert small < 100
    many = edges_of([[(0, 0), *[(1, i / 5000) for i in range(5000)]]])
    assert sum(1 + len(own) for *_, own in polygon_index.cut_polygon(many)) < 10 * len(many)


@pytest.mark.parametrize("limit", [joins.BROADCAST_EDGES, -1])
def test_one_large_polygon_among_small_ones(monkeypatch, spark, limit):
    monkeypatch.setattr(joins, "BROADCAST_EDGES", limit)
    monkeypatch.setattr(cells.grid_join, "__defaults__", (64,))
    shapes = [("large", [star(20_000, 30.0, 30.0, 40.0)])]
    shapes += [(f"{i}_{j}", [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]]) for i in range(60) for j in range(60)]
    shapes += [("hole", [[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (2, 7), (7, 7), (7, 2)]]),
               ("L", [[(20, 20), (29, 20), (29, 21), (21, 21), (21, 29), (20, 29)]]), ("none", None), ("line", [[(0, 0), (5, 5)]])]
    frame = spark.createDataFrame([(n, None if r is None else as_geometry(r)) for n, r in shapes], f"name string, geometry {G.GEOMETRY}")
    random = np.random.default_rng(1)
    points = [(float(x), float(y)) for x, y in [*random.uniform(-5, 65, (120, 2)), *random.integers(0, 40, (60, 2)) / 2, *[(3.3, 3.3)] * 200]]
    points += [(None, 1.0), (1.0, None), (float("nan"), 2.0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, longitude double, latitude double")
    found = {(r.id, r["shape"]) for r in joins.join_polygons(table, frame, {"name": "shape"}).collect()}
    expected = set()
    edges = [(n, edges_of(r)) for n, r in shapes if r is not None]
    xs, ys = (np.array([np.nan if p[c] is None else p[c] for p in points]) for c in (0, 1))
    within = {n: brute_inside_all(e, xs, ys) for n, e in edges}
    for i in range(len(points)):
        expected |= {(i, n) for n in {n for n, hit in within.items() if hit[i]} or {None}}
    assert found == expected


def test_crowded_cells_are_grids_of_tasks(spark):
    """Half of all rows of both sides have one key: no task gets more than a bounded part of either."""
    a = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    crowded = cells.crowded_keys(a, b, ["k"], 100)
    assert [tuple(r) for r in crowded.collect()] == [(0, 20, 15)]
    for side, other, df, spread in (("a", "b", a, "a"), ("b", "a", b, "b")):
        dealt = cells.in_grid(df, ["k"], crowded, F.xxhash64(spread), side, other)
        assert dealt.groupBy("k", "part_a", "part_b").count().agg(F.max("count")).first()[0] < 150
    joined = cells.grid_join(a, b, ["k"], F.xxhash64("a"), F.xxhash64("b"), 100)
    assert joined.count() == 2000 * 1500 + 1500 == joined.distinct().count()
