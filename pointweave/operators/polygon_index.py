"""Polygons as quadtree cells that hold only the edges crossing them.

Cells are squares of side ``2 ** -level`` degrees at multiples of their side, so cell numbers and borders are exact in
doubles and need no pass over the data. A polygon starts with the cells of its own size. A cell with more than
``EDGES_PER_CELL`` edges is cut into four, down to cells that few edges cross. A cell without edges is inside, and then a
row without edges, or outside, and dropped. The index of a polygon so grows with its edges, not with its area: a polygon of
20,000 vertices around the study area is some ten thousand small rows, beside polygons of one house each.

The even-odd test needs no edge outside of the cell. ``corner`` states whether the cell's lower right corner is inside. The
path from there goes up along the right border and then left to the point, and each edge it crosses changes sides. The
corner of a cut cell is settled from its parent's corner and edges in the same way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import geometry as G

EDGES_PER_CELL = 16
#: Cells that a polygon's box spans per axis at first, at least half as many.
FIRST_CELLS = 4
#: Levels that a cell is cut down at most. Many edges in one vertex stay together there.
CUTS = 24
COARSEST, FINEST = -12, 44
#: Cells and edges in them that a polygon's index has at most for each of its edges. Edges that lie on each other or close
#: together along their whole length would else be cut for ever.
ROWS_PER_EDGE = 8

_EDGE = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")])


# The parity rule, once for arrays in tasks and once for columns --------------------------------------------------------


def _crossed(e: np.ndarray, x: float, y: float, right: float, low: float) -> int:
    """Parity of the edges crossed from (right, low) up to (right, y) and from there to (x, y).

    Points are taken as moved by an infinitely small step up and a larger, still infinitely small one to the right, so that
    no vertex or edge is ever hit.
    """
    ax, ay, bx, by = e.T
    dx, dy = bx - ax, by - ay

    def side(px: float, py: float) -> np.ndarray:
        return dx * (py - ay) - dy * (px - ax)

    def to_the_right(px: float, py: float) -> np.ndarray:
        s = side(px, py)
        return np.where(dy > 0, s > 0, s < 0)

    def above(px: float, py: float) -> np.ndarray:
        s = side(px, py)
        return np.where(dx > 0, s < 0, s > 0) | (s == 0) & (dx * dy > 0)

    level = (ay > y) != (by > y)
    across = level & (to_the_right(x, y) != to_the_right(right, y))
    up = ((ax > right) != (bx > right)) & (above(right, y) != above(right, low))
    return int(across.sum() + up.sum()) & 1


def inside_cell(x: Column, y: Column, edges: Column, corner: Column, right: Column, low: Column) -> Column:
    """Whether a point of a cell is strictly inside the polygon; points on an edge are not."""

    def step(state: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

        def side(px: Column, py: Column) -> Column:
            return dx * (py - e["y1"]) - dy * (px - e["x1"])

        def to_the_right(s: Column) -> Column:
            return F.when(dy > 0, s > 0).otherwise(s < 0)

        def above(s: Column) -> Column:
            return F.when(dx > 0, s < 0).otherwise(s > 0) | ((s == 0) & (dx * dy > 0))

        here, there = side(x, y), side(right, y)
        on_edge = ((here == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                   & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
        across = ((e["y1"] > y) != (e["y2"] > y)) & (to_the_right(here) != to_the_right(there))
        up = ((e["x1"] > right) != (e["x2"] > right)) & (above(there) != above(side(right, low)))
        return F.when(state < 0, state).when(on_edge, F.lit(-1)).when(across != up, F.lit(1) - state).otherwise(state)

    return F.aggregate(edges, F.when(corner, F.lit(1)).otherwise(F.lit(0)), step) == 1


# Cutting polygons ------------------------------------------------------------------------------------------------------


def _meets(e: np.ndarray, x0: float, y0: float, side: float) -> np.ndarray:
    """Edges that meet the closed cell, with a hair of slack: the box test, and the cell not all on one side."""
    slack = side * 1e-9
    left, low, right, high = x0 - slack, y0 - slack, x0 + side + slack, y0 + side + slack
    ax, ay, bx, by = e.T
    near = ((np.maximum(ax, bx) >= left) & (np.minimum(ax, bx) <= right)
            & (np.maximum(ay, by) >= low) & (np.minimum(ay, by) <= high))
    dx, dy = bx - ax, by - ay
    sides = [dx * (py - ay) - dy * (px - ax) for px in (left, right) for py in (low, high)]
    return near & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def cut_polygon(e: np.ndarray, most: int = EDGES_PER_CELL) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """Cells ``level, cx, cy, corner, edges`` of a polygon of the edges ``e`` (rows x1, y1, x2, y2)."""
    e = e[np.isfinite(e).all(axis=1) & ((e[:, :2] != e[:, 2:]).any(axis=1))]
    if not len(e):
        return
    min_x, min_y = np.minimum(e[:, :2], e[:, 2:]).min(axis=0)
    max_x, max_y = np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
    first = int(np.clip(np.floor(np.log2(FIRST_CELLS / max(max_x - min_x, max_y - min_y, 2.0**-60))), COARSEST, FINEST))
    last = min(FINEST, first + CUTS)
    side = 2.0**-first
    # The lower right of everything is outside, so the first corners are settled from there.
    far, deep = (np.floor(max_x / side) + 2) * side, (np.floor(min_y / side) - 1) * side
    queue, rows, number = [], 0, 0

    def push(level: int, cx: int, cy: int, corner: int, own: np.ndarray) -> None:
        nonlocal rows, number
        if len(own) or corner:
            heapq.heappush(queue, (-len(own), number, level, cx, cy, corner, own))
            rows, number = rows + 1 + len(own), number + 1

    for cx in range(int(np.floor(min_x / side)), int(np.floor(max_x / side)) + 1):
        for cy in range(int(np.floor(min_y / side)), int(np.floor(max_y / side)) + 1):
            corner = _crossed(e, (cx + 1) * side, cy * side, far, deep)
            push(first, cx, cy, corner, e[_meets(e, cx * side, cy * side, side)])
    # The fullest cell first, so that what is left uncut by the bound on rows has the fewest edges possible.
    allowed = 64 + ROWS_PER_EDGE * len(e)
    while queue and -queue[0][0] > most and rows < allowed:
        _, _, level, cx, cy, corner, own = heapq.heappop(queue)
        if level >= last:
            yield level, cx, cy, bool(corner), own
            continue
        rows -= 1 + len(own)
        side, half = 2.0**-level, 2.0**-(level + 1)
        for ix in (2 * cx, 2 * cx + 1):
            for iy in (2 * cy, 2 * cy + 1):
                inner = corner ^ _crossed(own, (ix + 1) * half, iy * half, (cx + 1) * side, cy * side)
                push(level + 1, ix, iy, inner, own[_meets(own, ix * half, iy * half, half)])
    for _, _, level, cx, cy, corner, own in queue:
        yield level, cx, cy, bool(corner), own


def _cut_all(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("edges")
            lists = batch.column(at)
            for start in range(0, batch.num_rows, 256):
                rows, cells, parts = [], [], []
                for i in range(start, min(start + 256, batch.num_rows)):
                    edges = lists[i].values
                    if edges is None:
                        continue
                    table = np.column_stack([edges.field(n).to_numpy(zero_copy_only=False) for n in range(4)]).astype(float)
                    for level, cx, cy, corner, own in cut_polygon(table, most):
                        rows.append(i)
                        cells.append((level, cx, cy, corner))
                        parts.append(own)
                if not rows:
                    continue
                flat = np.concatenate(parts)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(flat[:, c]) for c in range(4)], fields=list(_EDGE)))
                kept = batch.drop_columns(["edges"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int64()),
                     pa.array([c[2] for c in cells], pa.int64()), pa.array([c[3] for c in cells], pa.bool_()), own],
                    [*kept.schema.names, "level", "cx", "cy", "corner", "edges"])

    return run


def polygon_cells(polygons: DataFrame, geometry: str, columns: list[str], most: int = EDGES_PER_CELL) -> DataFrame:
    """``columns`` of each polygon once for each of its cells, with ``level, cx, cy, corner, edges``.

    Polygons without a geometry, or without area, have no cells.
    """
    edge = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    rows = polygons.select(*columns, G.edges(F.col(geometry)).cast(edge).alias("edges"))
    schema = T.StructType([*[rows.schema[c] for c in columns], *T.StructType.fromDDL(
        f"level int, cx bigint, cy bigint, corner boolean, edges {edge}").fields])
    return rows.mapInArrow(_cut_all(most), schema)


def cell_number(value: Column, level: Column | int) -> Column:
    """The cell of a coordinate: exact, as the sides are powers of two."""
    scale = F.lit(2.0**level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(value * scale).cast("bigint")


def right_border(cx: Column, level: Column) -> Column:
    return (cx + 1) * F.pow(F.lit(2.0), -level)


def low_border(cy: Column, level: Column) -> Column:
    return cy * F.pow(F.lit(2.0), -level)
