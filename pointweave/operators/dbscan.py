"""Density-based clustering, exact and without materialising neighbour pairs.

Cells have a side just under eps / sqrt(2), so points of one cell are always neighbours of each other. A cell with
min_pts points is all core with no distance test; only the points of sparse cells (fewer than min_pts each) count
neighbours, which bounds what any point can be matched with. Clusters are components of the graph of core cells.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of, squared_distance
from ..session import cut
from .cells import BROADCAST_KEYS, HOT_SHARE, cell, hot_keys, lookup_join, neighbour_offsets, split_join
from .components import tiled_components
from .indexing import dense_index

TILE_CELLS = 64
# Point pairs of two cells compared directly up to this many; larger cell pairs are subdivided.
DIRECT_PAIRS = 16384
# Subdivision per axis and step.
SUBDIVISION = 8


class Clusters(NamedTuple):
    points: DataFrame
    """Input rows with ``cluster_id`` (-1 for noise) and ``is_core``."""
    summary: DataFrame
    """One row: ``n_clusters, n_noise``."""


def dbscan(df: DataFrame, eps: float, min_pts: int, id: str = "incident_id", x: str = "longitude",
           y: str = "latitude") -> DataFrame:
    """Rows with ``cluster_id`` and ``is_core``.

    Clusters are numbered from 0 by their smallest core id; a border point joins the lowest numbered cluster within
    reach; the rest, and rows without coordinates, are noise (-1).
    """
    if eps <= 0:
        raise ValueError("eps must be > 0")
    if min_pts < 1:
        raise ValueError("min_pts must be >= 1")
    side = eps / math.sqrt(2) * (1 - 1e-9)
    points = df.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = cut(points.dropna().withColumns({"cx": cell(F.col("x"), side), "cy": cell(F.col("y"), side)}))
    at = ["cx", "cy"]

    cells = cut(points.groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    # Cells above both bars: at most 1 / HOT_SHARE of them, and all of their points are core.
    hot_rows = max(min_pts, total * HOT_SHARE)
    hot = cells.filter(F.col("n") > hot_rows).select(*at, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))
    hot_cells = F.broadcast(hot.select(*at))

    crowded = points.join(hot_cells, at, "left_semi")
    others = points.join(hot_cells, at, "left_anti").join(cells, at)
    sparse = cut(others.filter(F.col("n") < min_pts).drop("n"))
    dense = crowded.unionByName(others.filter(F.col("n") >= min_pts).drop("n"))

    probes = _around(sparse, side, eps)
    near = split_join(probes, points, at, "id", hot)
    counted = near.filter(_within(eps)).groupBy("q_id").agg(F.count(F.lit(1)).alias("neighbours"))
    sparse_core = sparse.join(counted.filter(F.col("neighbours") >= min_pts).select(F.col("q_id").alias("id")), "id",
                              "left_semi")
    core = cut(dense.unionByName(sparse_core))
    rest = sparse.join(core.select("id"), "id", "left_anti")

    corner = cut(_profiles(core, at))
    links = _linked_cells(core, corner, side, eps)
    tile = {f"{end}_t{c}": F.floor(F.col(f"{end}_c{c}") / TILE_CELLS) for end in ("src", "dst") for c in "xy"}
    roots = tiled_components(links.withColumns(tile).select(
        F.col("src_first").alias("src"), F.col("dst_first").alias("dst"), *tile))
    labelled = cut(corner.select(*at, F.col("first").alias("id")).join(roots, "id", "left").select(
        *at, F.coalesce("label", "id").alias("root")))
    numbers = cut(dense_index(labelled.select("root").distinct(), "root", "cluster_id"))
    # The root of a large cluster is a hot key here. A list of few clusters goes to all tasks.
    numbered = (labelled.join(F.broadcast(numbers), "root") if numbers.count() <= BROADCAST_KEYS
                else lookup_join(labelled, numbers, ["root"], hot_keys(labelled, ["root"])))
    cell_clusters = cut(numbered.select(*at, "cluster_id"))

    core_labels = lookup_join(core.select("id", *at), cell_clusters, at, hot).select("id", "cluster_id", F.lit(True).alias("is_core"))
    touched = split_join(_around(rest, side, eps), core, at, "id", hot).filter(_within(eps)).select("q_id", *at).distinct()
    border_labels = (touched.join(cell_clusters, at).groupBy(F.col("q_id").alias("id"))
                     .agg(F.min("cluster_id").alias("cluster_id")).withColumn("is_core", F.lit(False)))
    labels = core_labels.unionByName(border_labels).withColumnRenamed("id", id)
    return df.join(labels, id, "left").withColumns({
        "cluster_id": F.coalesce("cluster_id", F.lit(-1)).cast("bigint"),
        "is_core": F.coalesce("is_core", F.lit(False))})


def _within(eps: float) -> Column:
    return squared_distance(F.col("x"), F.col("y"), F.col("q_x"), F.col("q_y")) <= eps * eps


def _around(points: DataFrame, side: float, eps: float) -> DataFrame:
    """Each point once per cell of the surrounding 5 x 5 block that comes within reach."""
    rows = points.select(F.col("id").alias("q_id"), F.col("x").alias("q_x"), F.col("y").alias("q_y"), "cx", "cy",
                         F.explode(neighbour_offsets(2)).alias("o"))
    rows = rows.withColumns({"cx": F.col("cx") + F.col("o.dx"), "cy": F.col("cy") + F.col("o.dy")}).drop("o")
    gap_x = F.greatest(F.col("cx") * side - F.col("q_x"), F.col("q_x") - (F.col("cx") + 1) * side, F.lit(0.0))
    gap_y = F.greatest(F.col("cy") * side - F.col("q_y"), F.col("q_y") - (F.col("cy") + 1) * side, F.lit(0.0))
    return rows.filter(gap_x * gap_x + gap_y * gap_y <= (eps * (1 + 1e-6)) ** 2)


# Links between core cells ----------------------------------------------------------------------------------------


def _profiles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: count, first id, tight box and up to eight outermost points."""
    x, y = F.col("x"), F.col("y")
    extremes = []
    for direction in (x, y, x + y, x - y):
        tagged = F.struct(direction.alias("d"), x.alias("x"), y.alias("y"))
        extremes += [F.min(tagged), F.max(tagged)]
    outer = F.array(*[F.struct(e["x"].alias("x"), e["y"].alias("y")) for e in extremes])
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.array_distinct(outer).alias("outer"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _apart(eps: float) -> Column:
    """Boxes too far from each other for any pair of points."""
    dx = F.greatest(F.col("src_x0") - F.col("dst_x1"), F.col("dst_x0") - F.col("src_x1"), F.lit(0.0))
    dy = F.greatest(F.col("src_y0") - F.col("dst_y1"), F.col("dst_y0") - F.col("src_y1"), F.lit(0.0))
    return dx * dx + dy * dy > (eps * (1 + 1e-9)) ** 2


def _touching(eps: float) -> Column:
    """Some pair of outermost points is within reach: a sufficient condition."""
    return F.exists("src_outer", lambda a: F.exists("dst_outer", lambda b: squared_distance(
        a["x"], a["y"], b["x"], b["y"]) <= eps * eps))


def _linked_cells(core: DataFrame, profiles: DataFrame, side: float, eps: float) -> DataFrame:
    """Neighbouring core cells with some pair of core points within reach."""
    half = F.filter(neighbour_offsets(2), lambda o: (o["dx"] > 0) | ((o["dx"] == 0) & (o["dy"] > 0)))
    src = _prefixed(profiles, "src_").withColumn("o", F.explode(half)).withColumns(
        {"dst_cx": F.col("src_cx") + F.col("o.dx"), "dst_cy": F.col("src_cy") + F.col("o.dy")}).drop("o")
    pairs = src.join(_prefixed(profiles, "dst_"), ["dst_cx", "dst_cy"]).filter(~_apart(eps))
    pairs = cut(pairs.withColumn("linked", _touching(eps)))
    ends = ["src_cx", "src_cy", "src_first", "dst_cx", "dst_cy", "dst_first"]
    links = pairs.filter("linked").select(*ends)
    open_pairs = pairs.filter(~F.col("linked")).select(*ends, "src_n", "dst_n")
    if open_pairs.isEmpty():
        return links
    small = F.col("src_n") * F.col("dst_n") <= DIRECT_PAIRS
    links = links.unionByName(_compare_directly(core, open_pairs.filter(small), eps, ends))
    large = open_pairs.filter(~small)
    return links if large.isEmpty() else links.unionByName(_subdivide(core, large.select(*ends), side, eps, ends))


def _compare_directly(core: DataFrame, pairs: DataFrame, eps: float, ends: list[str]) -> DataFrame:
    """Point comparison for cell pairs with at most DIRECT_PAIRS combinations each."""
    a = core.select(F.col("cx").alias("src_cx"), F.col("cy").alias("src_cy"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    b = core.select(F.col("cx").alias("dst_cx"), F.col("cy").alias("dst_cy"), "x", "y")
    return (pairs.select(*ends).join(a, ["src_cx", "src_cy"]).join(b, ["dst_cx", "dst_cy"]).filter(_within(eps))
            .select(*ends).distinct())


def _subdivide(core: DataFrame, pairs: DataFrame, side: float, eps: float, ends: list[str]) -> DataFrame:
    """Decide crowded cell pairs by splitting both cells again and again, keeping sub-cell pairs still in question.

    A sub-cell pair is settled when its outermost points meet, when its boxes are apart, or when both hold one
    location. Only the pairs of cells in question are split, and each step shrinks the cells eightfold.
    """
    pair_key = ["src_cx", "src_cy", "dst_cx", "dst_cy"]
    involved = pairs.select(F.col("src_cx").alias("cx"), F.col("src_cy").alias("cy")).unionByName(
        pairs.select(F.col("dst_cx").alias("cx"), F.col("dst_cy").alias("cy"))).distinct()
    # Coinciding points count once here.
    points = cut(core.join(involved, ["cx", "cy"], "left_semi").groupBy("cx", "cy", "x", "y").agg(F.min("id").alias("id")))
    found, step = None, side
    state = pairs.select(*ends)
    parents: list[str] = []
    for _ in range(18):
        step /= SUBDIVISION
        inner = points.withColumns({"sx": cell(F.col("x"), step), "sy": cell(F.col("y"), step)})
        inner = inner.withColumns({"px": cell(F.col("x"), step * SUBDIVISION), "py": cell(F.col("y"), step * SUBDIVISION)})
        subs = cut(_profiles(inner, ["cx", "cy", "px", "py", "sx", "sy"]).drop("first"))
        tables = []
        for end in ("src", "dst"):
            table = _prefixed(subs, f"{end}_")
            tables.append(table if parents else table.drop(f"{end}_px", f"{end}_py"))
        on = [[f"{e}_cx", f"{e}_cy"] + ([f"{e}_px", f"{e}_py"] if parents else []) for e in ("src", "dst")]
        tried = state.join(tables[0], on[0]).join(tables[1], on[1]).filter(~_apart(eps))
        tried = cut(tried.withColumn("linked", _touching(eps)))
        hits = tried.filter("linked").select(*ends).distinct()
        found = hits if found is None else found.unionByName(hits)
        single = any_of([(F.col(f"{e}_x0") < F.col(f"{e}_x1")) | (F.col(f"{e}_y0") < F.col(f"{e}_y1")) for e in ("src", "dst")])
        left = tried.filter(~F.col("linked") & single).join(hits.select(*pair_key), pair_key, "left_anti")
        parents = ["src_px", "src_py", "dst_px", "dst_py"]
        state = cut(left.select(*ends, F.col("src_sx").alias("src_px"), F.col("src_sy").alias("src_py"),
                                F.col("dst_sx").alias("dst_px"), F.col("dst_sy").alias("dst_py")))
        if state.isEmpty():
            return found
    raise RuntimeError("cell pairs stayed undecided")


# Results ---------------------------------------------------------------------------------------------------------


def cluster_counts(labelled: DataFrame, label: str = "cluster_id") -> DataFrame:
    """``n_clusters, n_noise``. Labels run from 0 without gaps."""
    return labelled.agg(F.coalesce(F.max(label) + 1, F.lit(0)).cast("bigint").alias("n_clusters"),
                        F.count_if(F.col(label) == -1).alias("n_noise"))


def cluster_statistics(labelled: DataFrame, x: str = "longitude", y: str = "latitude",
                       label: str = "cluster_id") -> DataFrame:
    """Size, centroid and root-mean-square distance to the centroid per cluster."""
    return labelled.filter(F.col(label) >= 0).groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), F.avg(x).alias("centroid_lon"), F.avg(y).alias("centroid_lat"),
        F.sqrt(F.var_pop(x) + F.var_pop(y)).alias("spread_deg"))


def run_dbscan(df: DataFrame, eps: float = 0.05, min_pts: int = 10, id: str = "incident_id", x: str = "longitude",
               y: str = "latitude") -> Clusters:
    points = dbscan(df, eps, min_pts, id, x, y)
    return Clusters(points, cluster_counts(points))
