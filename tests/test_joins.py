import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_table, mixed_points
from pointweave.functions import geometry as G
from pointweave.functions.columns import rounded_half_up
from pointweave.operators import blocks, contiguity, joins


def gaps(a, b):
    return np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)


@pytest.mark.parametrize("radius", [0.1, 0.03])
def test_range_join_against_brute_force(cloud, cloud_table, radius):
    found = {(r.query_id, r.data_id) for r in joins.range_join(cloud_table, cloud_table, radius).collect()}
    dx, dy = cloud[:, None, 0] - cloud[None, :, 0], cloud[:, None, 1] - cloud[None, :, 1]
    assert found == set(map(tuple, np.argwhere(dx * dx + dy * dy <= radius * radius).tolist()))


@pytest.mark.parametrize("tiles", [256, 4])
def test_range_join_of_two_tables_in_tiles(monkeypatch, spark, cloud, cloud_table, tiles):
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    monkeypatch.setattr(joins, "RANGE_TILES", tiles)
    other = mixed_points(120, 7)
    queries = as_table(spark, np.vstack([other, other[:9]])).withColumn("name", F.concat(F.lit("q"), "id")).drop("id")
    found = joins.range_join(queries, cloud_table, 0.2, query_id="name").collect()
    distance = gaps(np.vstack([other, other[:9]]), cloud)
    want = {(f"q{i}", j): distance[i, j] for i, j in np.argwhere(distance <= 0.2).tolist()}
    assert len(found) == len(want) and {(r.query_id, r.data_id): r.distance for r in found} == want


def test_range_join_keeps_rows_that_share_an_id_and_skips_points_without_a_place(spark):
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.5, 0.0), (3, float("inf"), 0.0), (4, None, 0.0), (5, 0.0, float("nan")),
            (6, 0.0, float("-inf")), (None, 0.0, 0.0), (7, 1e300, 0.0)]
    table = spark.createDataFrame(rows, "id bigint, x double, y double")
    found = sorted((r.query_id, r.data_id) for r in joins.range_join(table, table, 1.0).collect())
    assert found == [(1, 1)] * 4 + [(1, 2)] * 2 + [(2, 1)] * 2 + [(2, 2), (7, 7)]
    assert joins.range_join(table.limit(0), table, 1.0).count() == joins.range_join(table, table.limit(0), 1.0).count() == 0


def test_range_join_is_small_on_disk(spark, tmp_path):
    points = np.random.default_rng(3).uniform(0, 0.1, (6000, 2))
    table = as_table(spark, points).repartition(4).persist()
    joins.range_join(table, table, 0.02).select("query_id", "data_id").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert pairs > 3_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs


def test_nothing_within_radius_zero(cloud_table):
    assert joins.range_join(cloud_table, cloud_table, 0).count() == 0
    assert joins.count_within(cloud_table, cloud_table, 0).agg(F.sum("neighbours")).first()[0] == 0


@pytest.mark.parametrize("few_boxes", [4096, 0])
def test_count_within_against_brute_force(monkeypatch, cloud, cloud_table, few_boxes):
    monkeypatch.setattr(blocks, "SMALL_BOXES", few_boxes)
    monkeypatch.setattr(joins, "point_blocks", lambda *a: blocks.point_blocks(*a[:4], 16))
    got = {r.query_id: r.neighbours for r in joins.count_within(cloud_table, cloud_table, 0.2).collect()}
    assert [got[i] for i in range(len(cloud))] == (gaps(cloud, cloud) <= 0.2).sum(axis=1).tolist()


def expected_nearest(q, d, k):
    order = [sorted((g, j) for j, g in enumerate(row))[:k] for row in gaps(q, d)]
    return {(i, n + 1): j for i, row in enumerate(order) for n, (_, j) in enumerate(row)}


@pytest.mark.parametrize("small", [1024, 0])
def test_nearest_neighbours_against_brute_force(monkeypatch, spark, cloud, cloud_table, small):
    monkeypatch.setattr(joins, "SMALL_QUERIES", small)
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 32)
    queries = np.vstack([mixed_points(60, 5), [[30.0, -20.0], [0.0, 0.0]]])
    out = joins.nearest_neighbours(as_table(spark, queries), cloud_table, 4).collect()
    got = {(r.query_id, r.rank): r.data_id for r in out}
    want = expected_nearest(queries, cloud, 4)
    distance = gaps(queries, cloud)
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or distance[k[0], got[k]] == distance[k[0], want[k]] for k in want)


def test_nearest_neighbours_of_few_points(spark):
    data = as_table(spark, [(0, 0), (1, 0), (0, 1), (5, 5), (-1, -1)])
    query = as_table(spark, [(0.1, 0.1)])
    out = joins.nearest_neighbours(query, data, 2).orderBy("rank").collect()
    assert out[0].data_id == 0 and len(out) == 2
    assert joins.nearest_neighbours(query, data, 9).count() == 5
    with pytest.raises(ValueError):
        joins.nearest_neighbours(query, data, 0)
    within = as_table(spark, [(0, 0), (.5, 0), (.5, .5), (5, 5), (10, 10)])
    origin = as_table(spark, [(0, 0)])
    assert joins.range_join(origin, within, 1.0).count() == 3
    assert joins.count_within(origin, within, 1.0).first().neighbours == 3


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


SHAPES = [
    ("L", [[ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))]]),
    ("hole", [[ring((5, 0), (9, 0), (9, 4), (5, 4)), ring((6, 1), (6, 3), (8, 3), (8, 1))]]),
    ("two", [[ring((0, 5), (1, 5), (1, 6), (0, 6))], [ring((2, 5), (3, 5), (3, 6), (2, 6))]]),
    ("over", [[ring((0, 0), (2, 0), (2, 2), (0, 2))]]),
    ("far", [[ring((100, 100), (101, 100), (101, 101))]]),
]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(SHAPES, f"name string, geometry {G.GEOMETRY}").persist()


@pytest.mark.parametrize("limit", [joins.BROADCAST_EDGES, -1])
def test_point_in_polygon(monkeypatch, spark, shapes, limit):
    monkeypatch.setattr(joins, "BROADCAST_EDGES", limit)
    wanted = {0: ["L", "over"], 1: ["over"], 2: [None], 3: ["hole"], 4: [None], 5: ["two"], 6: [None], 7: [None], 8: ["far"],
              9: ["two"], 10: [None], 11: ["L"]}
    points = [(0.5, 0.5), (1.5, 1.5), (0.0, 0.5), (5.5, 2), (7, 2), (0.5, 5.5), (1.5, 5.5), (9, 2), (100.6, 100.2),
              (2.5, 5.5), (None, 1.0), (2.5, 0.5)]
    df = spark.createDataFrame([(i, None if x is None else float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, longitude double, latitude double")
    out = joins.join_polygons(df, shapes, {"name": "shape"}).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, []).append(r["shape"])
    assert {k: sorted(v, key=str) for k, v in got.items()} == wanted


def test_polygon_join_does_not_shuffle_points(spark, shapes):
    points = spark.range(10).select("id", (F.col("id") / 2).alias("longitude"), (F.col("id") / 3).alias("latitude"))
    plan = joins.join_polygons(points, shapes, {"name": "shape"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_area_and_centroid(shapes):
    c = G.centroid(F.col("geometry"))
    out = {r.name: tuple(r)[1:] for r in shapes.select("name", G.area(F.col("geometry")), c["x"], c["y"]).collect()}
    assert out["L"] == pytest.approx((5.0, 1.1, 1.1)) and out["hole"] == pytest.approx((12.0, 7.0, 2.0))
    assert out["two"] == pytest.approx((2.0, 1.5, 5.5)) and out["far"][0] == pytest.approx(0.5)


def test_contiguity(spark):
    cells = [(f"{i}{j}", [[ring((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]]) for i in range(3) for j in range(3)]
    cells.append(("alone", [[ring((50, 50), (51, 50), (51, 51))]]))
    units = spark.createDataFrame(cells, f"GEOID string, geometry {G.GEOMETRY}").withColumn("v", F.length("GEOID").cast("double"))
    queen, rook = contiguity.neighbours(units, "queen"), contiguity.neighbours(units, "rook")
    assert (queen.count(), rook.count()) == (40, 24)
    assert {r.dst for r in rook.filter("src = '00'").collect()} == {"01", "10"}
    lag = {r.GEOID: r.spatial_lag for r in contiguity.spatial_lag(units, queen, "v").collect()}
    assert lag["alone"] == 0.0 and lag["11"] == pytest.approx(2.0)


def test_rates(spark):
    counts = spark.createDataFrame([("a", 2020, 5), ("b", 2020, 5), ("c", 2020, 5)], "county string, year int, offense_count bigint")
    people = spark.createDataFrame([("a", 2020, 3000), ("b", 2020, 0)], "county string, year int, population bigint")
    out = {r.county: r.crime_rate_100k for r in joins.crime_rate(counts, people).collect()}
    assert out == {"a": 166.67, "b": None, "c": None}


def test_range_join_pairs_points_without_python(spark, cloud_table):
    # A pair that passes through a Python worker costs several times what generated code takes for it.
    plan = joins.range_join(cloud_table, cloud_table, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "InArrow" not in plan and "InPandas" not in plan


def test_rounding_without_decimals_is_what_round_returns(spark):
    rng = np.random.default_rng(5)
    near_ties = (rng.integers(0, 10**7, 3000) + 0.5) * 1e-9
    values = [*rng.uniform(0, 0.01, 3000), *near_ties, *np.nextafter(near_ties, 0), *np.nextafter(near_ties, 1), *rng.uniform(-5, 2000, 1000),
              0.0, -0.0, 1e300, 5e-324, 2.0**40 * 1e-9, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for digits in (0, 4, 9):
        same = F.round("v", digits).eqNullSafe(rounded_half_up(F.col("v"), digits))
        assert rows.filter(~same).count() == 0
