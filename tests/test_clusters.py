import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_table, mixed_points
from pointweave.operators import components, dbscan, hulls, indexing, kmeans


def scan_order_labels(points, eps, min_pts):
    """Plain definition: expand clusters in row order."""
    dx, dy = points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1]
    near = dx * dx + dy * dy <= eps * eps
    core = near.sum(axis=1) >= min_pts
    labels, nxt = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        todo = [i]
        labels[i] = nxt
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (labels < 0)):
                labels[j] = nxt
                if core[j]:
                    todo.append(j)
        nxt += 1
    return labels, core


def run(spark, points, eps, min_pts):
    out = dbscan.dbscan(as_table(spark, points).repartition(3), eps, min_pts, "id", "x", "y").collect()
    table = sorted((r.id, r.cluster_id, r.is_core) for r in out)
    return np.array([t[1] for t in table]), np.array([t[2] for t in table])


def lattice(cx, cy, n):
    return [(cx + (i % 5) * 0.005, cy + (i // 5) * 0.005) for i in range(n)]


@pytest.mark.parametrize("points,eps,min_pts,clusters,noise", [
    (lattice(0, 0, 20) + lattice(5, 5, 20) + [(100, 100)], 0.05, 3, 2, 1),
    ([(0, 0), (1, 0), (0, 1)], 0.001, 5, 0, 3),
    (lattice(0, 0, 15), 0.1, 5, 1, 0),
])
def test_hand_built(spark, points, eps, min_pts, clusters, noise):
    result = dbscan.run_dbscan(as_table(spark, points), eps, min_pts, "id", "x", "y")
    assert tuple(result.summary.first()) == (clusters, noise)


@pytest.mark.parametrize("n,seed,eps,min_pts,direct", [(300, 0, 0.05, 5, 4096), (300, 1, 0.02, 3, 4), (200, 2, 0.03, 1, 1)])
def test_against_definition(monkeypatch, spark, n, seed, eps, min_pts, direct):
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(dbscan, "TILE_CELLS", 4)
    points = mixed_points(n, seed)
    labels, core = run(spark, points, eps, min_pts)
    want, want_core = scan_order_labels(points, eps, min_pts)
    assert (core == want_core).all() and (labels == want).all()


def test_crowded_cells_on_the_edge_of_reach(monkeypatch, spark):
    """Two crowded arcs whose closest points are exactly eps apart, and one pair just beyond."""
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", 16)
    angle = np.linspace(-0.4, 0.4, 120)
    left = np.column_stack([0.2 * np.cos(angle) - 0.2, 0.2 * np.sin(angle)])
    right = np.column_stack([0.25 + 0.2 - 0.2 * np.cos(angle), 0.2 * np.sin(angle)])
    for shift in (0.0, 1e-7):
        points = np.vstack([left, right + [shift, 0.0]])
        labels, core = run(spark, points, 0.25, 20)
        want, want_core = scan_order_labels(points, 0.25, 20)
        assert (labels == want).all() and (core == want_core).all()


def test_bad_parameters(cloud_table):
    for eps, min_pts in ((0, 3), (0.1, 0)):
        with pytest.raises(ValueError):
            dbscan.dbscan(cloud_table, eps, min_pts, "id", "x", "y")


def test_statistics_and_hulls(spark):
    points = lattice(1, 2, 16)
    labelled = dbscan.dbscan(as_table(spark, points + [(9, 9), (9, 9)]), 0.1, 2, "id", "x", "y").persist()
    stats = dbscan.cluster_statistics(labelled, "x", "y").orderBy("cluster_id").collect()
    p = np.array(points)
    assert stats[0]["size"] == 16 and stats[0].centroid_lon == pytest.approx(p[:, 0].mean())
    assert stats[0].spread_deg == pytest.approx(np.sqrt(p[:, 0].var() + p[:, 1].var()))
    drawn = {r.cluster_id: r for r in hulls.cluster_hulls(labelled, 0.1, "x", "y").collect()}
    corners = {(round(v.x, 9), round(v.y, 9)) for v in drawn[0].geometry[0][0]}
    assert corners == {(1, 2), (1.02, 2), (1.02, 2.01), (1.0, 2.015)}
    assert len(drawn[1].geometry[0][0]) == hulls.CIRCLE_SIDES + 1


def test_convex_hull_holds_every_point(cloud):
    hull = hulls.convex_hull(cloud[:, 0], cloud[:, 1])
    nxt = np.roll(hull, -1, axis=0)
    cross = ((nxt[:, None, 0] - hull[:, None, 0]) * (cloud[None, :, 1] - hull[:, None, 1])
             - (nxt[:, None, 1] - hull[:, None, 1]) * (cloud[None, :, 0] - hull[:, None, 0]))
    assert (cross >= -1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (40, 2))] + [(500, 501), (502, 501)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    want = {v: root(v) for p in pairs if p[0] != p[1] for v in p}
    assert {r.id: r.label for r in components.components(edges).collect()} == want
    for origin in (0, -20):
        tiled = edges.withColumns({f"{end}_t{c}": F.floor(F.col(end) / size) + origin for end in ("src", "dst") for c, size in (("x", 7), ("y", 31))})
        got = {r.id: r.label for r in components.tiled_components(tiled.filter("src <> dst")).collect()}
        assert got == want
    assert components.tiled_components(tiled.limit(0)).count() == 0


def test_one_component_of_half_of_all_vertices(spark, monkeypatch):
    """A lattice of 96 x 96 vertices in one component, the rest in pairs: tasks get tiles, never a component."""
    vertex = spark.range(192 * 96).select(F.col("id"), (F.col("id") % 192).alias("x"), F.floor(F.col("id") / 192).alias("y"))
    step = vertex.select("*", F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))).alias("o"))
    step = step.withColumns({"ex": F.col("x") + F.col("o.dx"), "ey": F.col("y") + F.col("o.dy")}).filter("ex < 192 and ey < 96")
    step = step.filter("ex < 96 or (x >= 96 and x % 2 = 0 and o.dx = 1)")
    edges = step.select(F.col("id").alias("src"), (F.col("ey") * 192 + F.col("ex")).alias("dst"), *[
        F.floor(F.col(c) / 4).alias(n) for c, n in (("x", "src_tx"), ("y", "src_ty"), ("ex", "dst_tx"), ("ey", "dst_ty"))])
    written = []
    original = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(original(df)) or written[-1])
    labels = components.tiled_components(edges)
    sizes = labels.groupBy("label").count().groupBy("count").agg(F.count("*").alias("n"))
    assert {r["count"]: r.n for r in sizes.collect()} == {96 * 96: 1, 2: 48 * 96}
    maps = [t for t in written if "label" in t.columns]
    assert len(maps) == 3 and len(written) <= 2 * len(maps)
    for table in maps:
        tiles = [r["count"] for r in table.groupBy("tx", "ty").count().collect()]
        assert max(tiles) <= max(64, 3 * np.median(tiles))


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")).repartition(5)
    out = sorted((r.k, r.n) for r in indexing.dense_index(df, "k", "n").collect())
    assert [n for _, n in out] == list(range(1000))


def test_kmeans(spark):
    points = [(cx + dx, cy) for cx, cy in ((0, 0), (10, 0), (0, 10)) for dx in np.linspace(0, 1, 9)]
    df = as_table(spark, points, x="longitude", y="latitude")
    result = kmeans.run_kmeans(df, k=3, starts=3)
    assert result.centres.count() == 3 and result.points.select("kmeans_cluster").distinct().count() == 3
    assert result.summary.first().inertia == pytest.approx(3 * 9 * np.var(np.linspace(0, 1, 9)))
    curve = [r.inertia for r in kmeans.elbow(df, (2, 3, 4), starts=2).collect()]
    assert curve == sorted(curve, reverse=True)


def test_kmeans_rounds_are_shared(spark, cloud, monkeypatch):
    """All runs advance in one job a round, whatever the partitioning, and end where Lloyd's rounds end."""
    df = as_table(spark, cloud, x="longitude", y="latitude")
    scans = []
    original = kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda centres: scans.append(len(centres)) or original(centres))
    runs = kmeans._settled(kmeans._positions(df, "longitude", "latitude"), [(k, s) for k in (2, 5) for s in range(3)], 1)
    assert scans[0] == 6 and scans == sorted(scans, reverse=True) and len(scans) < 60
    for (k, s), (cost, centres) in runs.items():
        gap = ((cloud[:, None] - centres[None]) ** 2).sum(2)
        assert len(centres) == k and cost == pytest.approx(gap.min(1).sum())
        means = np.array([cloud[gap.argmin(1) == i].mean(0) for i in range(k)])
        assert np.abs(means - centres).max() <= kmeans.TOLERANCE
    again = kmeans._settled(kmeans._positions(df.repartition(7), "longitude", "latitude"), [(5, s) for s in range(3)], 1)
    assert [again[5, s][0] for s in range(3)] == pytest.approx([runs[5, s][0] for s in range(3)])
    few = as_table(spark, [(0, 0), (1, 1), (1, 1)], x="longitude", y="latitude")
    assert kmeans.run_kmeans(few, k=5, starts=2).summary.first().inertia == 0
    none = kmeans.run_kmeans(few.limit(0), k=2, starts=2)
    assert none.centres.count() == 0 and none.points.count() == 0


def test_hull_of_a_line_is_a_circle(spark):
    rows = [(1, float(i), float(i)) for i in range(4)] + [(2, 0.0, 0.0), (2, 1.0, 0.0), (2, 0.0, 1.0)]
    drawn = {r.cluster_id: r.geometry for r in hulls.cluster_hulls(
        spark.createDataFrame(rows, "cluster_id bigint, x double, y double"), 0.1, "x", "y").collect()}
    assert len(drawn[1][0][0]) > 4 and len(drawn[2][0][0]) == 4


def test_kmeans_adds_neighbours_together(spark, monkeypatch):
    """Locations lie along a curve, and runs of them that one centre is closest to are added as one."""
    monkeypatch.setattr(kmeans, "_RUN", 16)
    points = np.random.default_rng(3).uniform(0, 1, (4000, 2))
    places = kmeans._positions(as_table(spark, points, x="longitude", y="latitude"), "longitude", "latitude")
    held = places.coalesce(1).toPandas()
    assert np.median(np.hypot(np.diff(held.x), np.diff(held.y))) < 0.05
    centres = {(k, 0): np.random.default_rng(k).uniform(0, 1, (k, 2)) for k in (1, 2, 9)}
    got = next(kmeans._sums(centres)(iter([held.iloc[:3000], held.iloc[3000:]])))
    for (k, _), c in centres.items():
        gap = (held.x.to_numpy()[:, None] - c[:, 0]) ** 2 + (held.y.to_numpy()[:, None] - c[:, 1]) ** 2
        near, own = gap.argmin(axis=1), got[got.k == k]
        for name, v in (("w", 1.0), ("wx", held.x), ("wy", held.y), ("cost", gap.min(axis=1))):
            assert own[name].to_numpy() == pytest.approx(np.bincount(near, held.w * v, k))
