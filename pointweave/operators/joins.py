"""Spatial joins: point in polygon, within distance, counts within distance, nearest neighbours; and rate joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .block_tree import BOX, DROP, FAN_BITS, OPEN, POINTS, Leaves, Tree, gaps, named, near_blocks, nearest_pairs, node_pairs, tile_bits, with_points
from .blocks import point_blocks, task_count
from .cells import grid_join
from .polygon_index import cell_number, inside_cell, low_border, polygon_cells, right_border

# A polygon index is broadcast only below this many cells and edges (four doubles each, about 64 MB).
BROADCAST_EDGES = 2_000_000
# A query table up to this size is held by every task; larger ones take the block route.
SMALL_QUERIES = 1024
# Points per block in neighbour searches: small, since a block meets all blocks around its box.
SEARCH_BLOCK = 256
# Tiles of a count within a distance, at least, once there are as many blocks.
COUNT_TILES = 512
# Tiles of queries of a range join, at least, once there are as many blocks.
RANGE_TILES = 256
# Partitions of tiles in a range join, at most, unless the cluster asks for more.
MOST_PARTS = 4096
# Points per block in a range join: pairs of points are tried for each pair of blocks within the radius.
RANGE_BLOCK = 64
# Most blocks of queries, as a power of two, that look for their neighbours in one group.
NEAR_TILE_BITS = 6


# Point in polygon ------------------------------------------------------------------------------------------------


def join_polygons(points: DataFrame, polygons: DataFrame, columns: dict[str, str], lon: str = "longitude",
                  lat: str = "latitude", geometry: str = "geometry") -> DataFrame:
    """Left join of points to the polygons strictly containing them; one row per match, unmatched points kept.

    ``columns`` maps polygon columns to output names. The polygons become quadtree cells with few edges each
    (``polygon_index``), and a point can only lie in the polygons of its own cell on each level that has any. With a small
    index (checked) each level is a broadcast table of one row per cell, so points are never shuffled nor repeated. With a
    larger one only a row number and the coordinates travel to the cells, crowded cells are grids of tasks, and the matches
    are joined back by row number.
    """
    clashes = set(columns.values()) & set(points.columns)
    if clashes:
        raise ValueError(f"output columns already exist: {sorted(clashes)}")
    level, cx, cy = F.col("level"), F.col("cx"), F.col("cy")
    index = cut(polygon_cells(polygons, geometry, list(columns)).select(
        "level", "cx", "cy", F.struct("edges", "corner", right_border(cx, level).alias("right"), low_border(cy, level).alias("low"),
                                      *[F.col(src).alias(dst) for src, dst in columns.items()]).alias("polygon")))
    size = index.agg(F.sum(F.size("polygon.edges") + 1).alias("entries"), F.collect_set("level").alias("levels")).first()
    levels = sorted(size["levels"])
    x, y = (F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in (lon, lat))

    def inside(p: Column) -> Column:
        return inside_cell(x, y, p["edges"], p["corner"], p["right"], p["low"])

    if (size["entries"] or 0) <= BROADCAST_EDGES:
        located, found = points, [F.array().cast(T.ArrayType(index.schema["polygon"].dataType))]
        for at in levels:
            own, kx, ky = (f"__{n}_{at + 100}" for n in ("polygons", "cx", "cy"))
            cells = index.filter(level == at).groupBy(cx.alias(kx), cy.alias(ky)).agg(F.collect_list("polygon").alias(own))
            on = (cell_number(x, at) == F.col(kx)) & (cell_number(y, at) == F.col(ky))
            located = located.join(F.broadcast(cells), on, "left")
            found.append(F.coalesce(F.col(own), found[0]))
        matches = located.select(*points.columns, F.explode_outer(F.filter(F.concat(*found), inside)).alias("__match"))
        return matches.select(*points.columns, *[F.col("__match")[c].alias(c) for c in columns.values()])
    numbered = cut(points.withColumn("__row", F.monotonically_increasing_id()))
    keys = F.array(*[F.struct(F.lit(at).alias("level"), cell_number(F.col("__x"), at).alias("cx"),
                              cell_number(F.col("__y"), at).alias("cy")) for at in levels])
    probes = numbered.select("__row", x.alias("__x"), y.alias("__y")).dropna().select(
        "__row", "__x", "__y", F.explode(keys).alias("__key")).select("__row", "__x", "__y", "__key.*")
    x, y = F.col("__x"), F.col("__y")
    near = grid_join(probes, index, ["level", "cx", "cy"], F.xxhash64("__row"), F.xxhash64("polygon"))
    hits = near.filter(inside(F.col("polygon"))).select("__row", "polygon").withColumnRenamed("polygon", "__match")
    return numbered.join(hits, "__row", "left").select(*points.columns, *[F.col("__match")[c].alias(c) for c in columns.values()])


def attach_county(incidents: DataFrame, counties: DataFrame, county_name: str = "county_name",
                  lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add ``county`` and ``GEOID`` of the county containing each incident."""
    return join_polygons(incidents, counties, {county_name: "county", "GEOID": "GEOID"}, lon, lat)


def attach_city(incidents: DataFrame, places: DataFrame, place_name: str = "NAME",
                lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add ``place_name`` of the place containing each incident."""
    return join_polygons(incidents, places, {place_name: "place_name"}, lon, lat)


# Rates and counts ------------------------------------------------------------------------------------------------


def crime_rate(counts: DataFrame, population: DataFrame, county: str = "county", year: str = "year",
               count: str = "offense_count", people: str = "population") -> DataFrame:
    """Counts with the population of the same county and year and the rate per 100,000; no rate without people."""
    merged = counts.join(population.select(county, year, people), [county, year], "left")
    rate = F.try_divide(F.col(count).cast("double"), F.col(people).cast("double")) * 100_000
    return merged.withColumn("crime_rate_100k", F.bround(rate, 2))


def counts_on_polygons(polygons: DataFrame, counts: DataFrame, polygon_key: str = "county_name",
                       count_key: str = "county", count: str = "offense_count") -> DataFrame:
    """Total count per polygon, 0 where there is none."""
    totals = counts.groupBy(F.col(count_key).alias(polygon_key)).agg(F.sum(count).alias(count))
    return polygons.join(totals, polygon_key, "left").fillna(0, [count])


# Distances -------------------------------------------------------------------------------------------------------


def _named(df: DataFrame, id: str, x: str, y: str, prefix: str) -> DataFrame:
    return df.select(F.col(id).alias(prefix + "id"), F.col(x).cast("double").alias(prefix + "x"),
                     F.col(y).cast("double").alias(prefix + "y")).dropna()


def range_join(queries: DataFrame, data: DataFrame, radius: float, query_id: str = "id", data_id: str = "id",
               x: str = "x", y: str = "y") -> DataFrame:
    """All pairs within ``radius`` (inclusive): ``query_id, data_id, distance``; nothing for a radius of 0 or less.

    The result has every pair, so it grows with the square of the density; what is written on the way does not. A tile of
    queries, a run of bounded blocks, meets the blocks of data within the radius of its box, and a block travels once for
    each such tile. The blocks of data pass by the tile's blocks of queries, and generated code tells the pairs of points
    of one pair of blocks at a time, so memory is bounded however many pairs there are, and no pair passes through Python.
    Pairs come with all data of a block for a query in a row, which columnar files keep in few bytes.
    """
    q, d = (_named(t, i, x, y, "").filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
            for t, i in ((queries, query_id), (data, data_id)))
    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("data_id", d.schema["id"].dataType),
                           T.StructField("distance", T.DoubleType())])
    if radius <= 0:
        return queries.sparkSession.createDataFrame([], schema)
    size = min(SEARCH_BLOCK, RANGE_BLOCK)
    q_blocks = point_blocks(q, "x", "y", "id", size)
    d_blocks = q_blocks if queries is data and query_id == data_id else point_blocks(d, "x", "y", "id", size)
    q_tree, d_tree = Tree(q_blocks, F.col("n"), RANGE_TILES), Tree(d_blocks, F.col("n"), RANGE_TILES)

    def decide(low: np.ndarray, high: np.ndarray, same: np.ndarray) -> np.ndarray:
        return np.where(low > radius * (1 + 1e-9), DROP, OPEN)

    pairs = node_pairs(q_tree, d_tree, decide).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))
    near = near_blocks(pairs, d_tree, "b_id", q_tree, "a_id", radius)
    parts = max(1, min(q_tree.count, max(MOST_PARTS, task_count(q.sparkSession))))
    own, passing = (t.select(tile.alias("tile"), *[F.col(c).alias(f"{side}_{c}") for c in POINTS]).repartition(parts, "tile")
                    .sortWithinPartitions("tile", f"{side}_box_id")
                    for t, tile, side in ((q_tree.blocks, q_tree.tile, "q"), (near, F.col("a_id"), "d")))
    # Merging keeps a tile's blocks of queries in a buffer that can spill.
    met = passing.join(own.hint("merge"), "tile")
    return _pairs_within(met, radius).select(F.col("query_id"), F.col("data_id"), F.sqrt("gap").alias("distance"))


def _pairs_within(met: DataFrame, radius: float) -> DataFrame:
    """Pairs of the points of two blocks (``q_`` and ``d_``) in each row: ``query_id, data_id, gap``, the squared distance."""
    limit = radius * radius

    def beyond(c: str, low: Column, high: Column) -> Column:
        """How far the box of the data begins after ``high`` or ends before ``low``."""
        return F.greatest(F.col(f"d_min_{c}") - high, low - F.col(f"d_max_{c}"), F.lit(0.0))

    boxes = [beyond(c, F.col(f"q_min_{c}"), F.col(f"q_max_{c}")) for c in "xy"]
    near = met.filter(boxes[0] * boxes[0] + boxes[1] * boxes[1] <= limit * (1 + 1e-9))
    points = [f"d_{c}" for c in ("xs", "ys", "carried")]
    each = near.select(*[f"d_{c}" for c in BOX], *points, "q_xs", "q_ys", F.posexplode("q_carried").alias("i", "query_id"))
    each = each.withColumns({"x": F.get("q_xs", F.col("i")), "y": F.get("q_ys", F.col("i"))})
    facing = [beyond(c, F.col(c), F.col(c)) for c in "xy"]
    each = each.filter(facing[0] * facing[0] + facing[1] * facing[1] <= limit * (1 + 1e-9))
    both = each.select("query_id", "x", "y", "d_xs", "d_ys", F.posexplode("d_carried").alias("j", "data_id"))
    dx, dy = F.get("d_xs", F.col("j")) - F.col("x"), F.get("d_ys", F.col("j")) - F.col("y")
    return both.select("query_id", "data_id", (dx * dx + dy * dy).alias("gap")).filter(F.col("gap") <= limit)


def count_within(queries: DataFrame, data: DataFrame, radius: float, query_id: str = "id", x: str = "x",
                 y: str = "y") -> DataFrame:
    """Number of data points within ``radius`` of each query, 0 included: ``query_id, neighbours``.

    Works on pairs of tiles of bounded blocks. Locations are counted once with a weight. Tiles, or whole groups of tiles, that
    lie within the radius of a tile altogether count by their weights; only pairs that the radius cuts through read their
    points. Their blocks are judged alike in the task, which yields one count for each query and pair of tiles.
    """
    every = queries.select(F.col(query_id).alias("query_id"))
    if radius <= 0:
        return every.select("query_id", F.lit(0).cast("bigint").alias("neighbours"))
    weighted = _named(data.withColumn("one", F.lit(1)), "one", x, y, "").groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("weight"))
    q = _named(queries, query_id, x, y, "")
    q_tree = Tree(point_blocks(q, "x", "y", "id", SEARCH_BLOCK), F.col("n"), COUNT_TILES)
    d_tree = Tree(point_blocks(weighted, "x", "y", "weight", SEARCH_BLOCK),
                  F.aggregate("carried", F.lit(0).cast("bigint"), lambda a, w: a + w), COUNT_TILES)
    limit = radius * radius

    def decide(low: np.ndarray, high: np.ndarray, same: np.ndarray) -> np.ndarray:
        # Distances of points are compared as squares; boxes decide with a hair to spare.
        return np.where(low > radius * (1 + 1e-9), DROP, np.where(high < radius * (1 - 1e-9), 0, OPEN))

    def count_pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        queries, data = Leaves(a, "a"), Leaves(b, "b")
        found = np.zeros(len(queries.xs), "int64")
        # Weights are exact in doubles, and their product runs in BLAS.
        weight = data.carried.astype(float)
        totals = np.asarray([weight[data.points(j)].sum() for j in range(len(data))])
        none = np.zeros(len(data), bool)
        for i in range(len(queries)):
            own = queries.points(i)
            ax, ay, here = queries.xs[own], queries.ys[own], found[own]
            code = decide(*gaps([c[i] for c in queries.box], data.box), none)
            here += int(totals[code == 0].sum())
            for j in np.flatnonzero(code == OPEN):
                theirs = data.points(j)
                bx, by = data.xs[theirs], data.ys[theirs]
                m, n = _facing(ax, ay, bx, by, limit), _facing(bx, by, ax, ay, limit)
                dx, dy = bx[n][None, :] - ax[m][:, None], by[n][None, :] - ay[m][:, None]
                here[m] += ((dx * dx + dy * dy <= limit).astype(float) @ weight[theirs][n]).astype("int64")
        some = found > 0
        ids = pa.array(queries.carried[some], a.schema.field("a_carried").type.value_type, from_pandas=False)
        return pa.table({"query_id": ids, "part": pa.array(found[some])})

    pairs = node_pairs(q_tree, d_tree, decide)
    opened = with_points(pairs.filter(F.col("code") == OPEN).select(F.col("a").alias("a_id"), F.col("b").alias("b_id")), q_tree, d_tree, radius)
    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("part", T.LongType())])
    parts = opened.applyInArrow(count_pairs, schema)
    whole = _of_blocks(pairs.filter(F.col("code") != OPEN).groupBy("level", "a").agg(F.sum("b_weight").alias("part")), q_tree, d_tree)
    parts = parts.unionByName(whole.join(q_tree.blocks.select(q_tree.tile.alias("box_id"), "carried"), "box_id").select(
        F.explode("carried").alias("query_id"), "part"))
    counted = parts.groupBy("query_id").agg(F.sum("part").alias("neighbours"))
    return every.join(counted, "query_id", "left").fillna(0, ["neighbours"])


def _of_blocks(sums: DataFrame, tree: Tree, other: Tree) -> DataFrame:
    """``box_id, part``: what the nodes above each leaf have been given, added up."""
    if other.small:
        return sums.select(F.col("a").alias("box_id"), "part")
    height = max(len(tree.levels), len(other.levels))
    above = tree.levels[0].select("box_id", F.posexplode(F.array(*[F.shiftright("node", FAN_BITS * at) for at in range(height)]))
                                  ).select("box_id", F.col("pos").alias("level"), F.col("col").alias("a"))
    return above.join(sums, ["level", "a"]).groupBy("box_id").agg(F.sum("part").alias("part"))


def _closest(query: np.ndarray, id: np.ndarray, gap: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k smallest (gap, id) entries per query, sorted by query."""
    order = np.lexsort((id, gap, query))
    query, id, gap = query[order], id[order], gap[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return query[rank < k], id[rank < k], gap[rank < k]


def _facing(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, limit: float) -> np.ndarray:
    """Places of the points of ``a`` whose squared distance to the box of ``b`` is within ``limit``."""
    dx = np.maximum(np.maximum(bx.min() - ax, ax - bx.max()), 0.0)
    dy = np.maximum(np.maximum(by.min() - ay, ay - by.max()), 0.0)
    return np.flatnonzero(dx * dx + dy * dy <= limit * (1 + 1e-9))


class _Best:
    """The k closest points found so far for a fixed array of queries."""

    def __init__(self, qid: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int):
        self.qid, self.qx, self.qy, self.k = qid, qx, qy, k
        self.bar = np.full(len(qid), np.inf)
        self.rows = (np.empty(0, "int64"), None, np.empty(0))

    def add(self, did: np.ndarray, dx: np.ndarray, dy: np.ndarray, step: int = 256) -> None:
        near = _facing(dx, dy, self.qx, self.qy, self.bar.max())
        did, dx, dy = did[near], dx[near], dy[near]
        if not len(did):
            return
        found = [] if self.rows[1] is None else [self.rows]
        for s in range(0, len(self.qid), step):
            part = slice(s, s + step)
            gx, gy = dx[None, :] - self.qx[part, None], dy[None, :] - self.qy[part, None]
            gap = gx * gx + gy * gy
            bar = self.bar[part]
            if gap.shape[1] > self.k and not np.isfinite(bar).all():
                bar = np.minimum(bar, np.partition(gap, self.k - 1, axis=1)[:, self.k - 1])
            rows, cols = np.nonzero(gap <= bar[:, None])
            found.append((rows + s, did[cols], gap[rows, cols]))
        self.rows = _closest(*[np.concatenate(c) for c in zip(*found)], self.k)
        query, _, gap = self.rows
        full = np.bincount(query, minlength=len(self.qid)) >= self.k
        self.bar = np.full(len(self.qid), np.inf)
        np.maximum.at(worst := np.full(len(self.qid), -np.inf), query, gap)
        self.bar[full] = worst[full]

    def table(self) -> pd.DataFrame:
        query, id, gap = self.rows
        return pd.DataFrame({"query_id": self.qid[query], "data_id": [] if id is None else id, "gap": gap})


def nearest_neighbours(queries: DataFrame, data: DataFrame, k: int, query_id: str = "id", data_id: str = "id",
                       x: str = "x", y: str = "y") -> DataFrame:
    """Up to ``k`` closest data points per query by ascending distance, ties by smaller id:
    ``query_id, data_id, distance, rank``."""
    if k <= 0:
        raise ValueError("k must be > 0")
    q, d = _named(queries, query_id, x, y, ""), _named(data, data_id, x, y, "")
    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType),
                           T.StructField("data_id", d.schema["id"].dataType), T.StructField("gap", T.DoubleType())])
    few = q.limit(SMALL_QUERIES + 1).toPandas()
    if len(few) <= SMALL_QUERIES:
        found = d.mapInPandas(_scan_for(few, k), schema)
    else:
        found = _block_candidates(q, d, k, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "data_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "data_id", F.sqrt("gap").alias("distance"), "rank")


def _scan_for(queries: pd.DataFrame, k: int):
    """One pass over the data with a small, checked query table: each task keeps its k best per query."""
    columns = [queries[c].to_numpy() for c in ("id", "x", "y")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(*columns, k)
        for batch in batches:
            if len(batch) and len(columns[0]):
                best.add(*[batch[c].to_numpy() for c in ("id", "x", "y")])
        yield best.table()

    return scan


def _block_candidates(q: DataFrame, d: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Candidates through pairs of blocks; data far from a block of queries is dropped in whole groups of blocks."""
    # Only the k smallest ids of one location can be answers; the ranked filter also runs before the shuffle.
    place = Window.partitionBy("x", "y").orderBy("id")
    d = d.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k).drop("nth")
    d_tree = Tree(point_blocks(d, "x", "y", "id", SEARCH_BLOCK), F.col("n"))
    size = int(min(SEARCH_BLOCK, max(16, q.count() / max(1, d_tree.count))))
    q_tree = Tree(point_blocks(q, "x", "y", "id", size), F.col("n"))

    def closest_pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        queries, own = Leaves(a, "a"), Leaves(b, "b")
        place = {box: i for i, box in enumerate(queries.ids.tolist())}
        partners = [[] for _ in range(len(queries))]
        for j, row in enumerate(b.sort_by("b_box_id")["partners"].to_pylist()):
            for r in row:
                partners[place[r["a_id"]]].append((r["gap"], j))
        found = []
        for i, near in enumerate(partners):
            mine = queries.points(i)
            best = _Best(queries.carried[mine], queries.xs[mine], queries.ys[mine], k)
            # Nearby blocks first, so that the bars drop early.
            for _, j in sorted(near):
                theirs = own.points(j)
                best.add(own.carried[theirs], own.xs[theirs], own.ys[theirs])
            found.append(best.table())
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True), schema=to_arrow_schema(schema), preserve_index=False)

    # All partners of one query block mostly meet it in one group, yet a block with very many partners uses several. A block
    # of data travels once for each group that needs it.
    bits = min(NEAR_TILE_BITS, tile_bits(q_tree.count, 4 * task_count(q.sparkSession)))
    pairs = nearest_pairs(q_tree, d_tree, k).withColumn("tile", F.shiftright("a_id", bits))
    asked = pairs.select("tile", "part", F.col("a_id").alias("box_id")).distinct().join(q_tree.blocks, "box_id")
    near = pairs.groupBy("tile", "part", F.col("b_id").alias("box_id")).agg(F.collect_list(F.struct("a_id", "gap")).alias("partners"))
    given = near.join(d_tree.blocks, "box_id")
    keys, carried = ("tile", "part"), F.col("partners").alias("partners")
    b_side = given.select(*[F.col(c).alias(c) for c in keys], carried, *[F.col(c).alias(f"b_{c}") for c in POINTS])
    return named(asked, "a", *keys).groupBy(*keys).cogroup(b_side.groupBy(*keys)).applyInArrow(closest_pairs, schema)
