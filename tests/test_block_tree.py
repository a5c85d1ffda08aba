import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_table, mixed_points
from pointweave.operators import block_tree, blocks, joins, ripley


def gaps(a, b):
    return np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)


@pytest.fixture
def tall(monkeypatch):
    """Trees of several levels: no table of boxes is small."""
    monkeypatch.setattr(blocks, "SMALL_BOXES", 0)


def crowd(n=400):
    """Half of all points in one tiny place, the rest spread over a wide area."""
    rng = np.random.default_rng(8)
    return np.vstack([rng.normal(0.3, 1e-4, (n // 2, 2)), rng.uniform(-5, 5, (n // 2, 2))])


def test_tree_levels(spark, tall):
    points = crowd()
    tree = block_tree.Tree(blocks.point_blocks(as_table(spark, points), "x", "y", "id", 4), F.col("n"))
    sizes = [t.count() for t in tree.levels]
    assert sizes[0] == tree.count >= 100 and sizes[-1] == 1 and all(b == -(-a // 8) for a, b in zip(sizes, sizes[1:]))
    for table in tree.levels:
        box = table.agg(F.sum("weight"), F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
        assert tuple(box) == (400, *points.min(0), *points.max(0))


@pytest.mark.parametrize("small", [0, 4096])
def test_ripley_reads_points_of_undecided_pairs_only(monkeypatch, spark, small):
    """Pairs of blocks that lie between two radii, or beyond the last, are settled by their boxes."""
    monkeypatch.setattr(blocks, "SMALL_BOXES", small)
    monkeypatch.setattr(ripley, "RIPLEY_BLOCK", 8)
    points = crowd()
    radii = np.array([0.1, 0.5, 1.5])
    met = []
    original = ripley.with_points
    monkeypatch.setattr(ripley, "with_points", lambda pairs, *trees: met.append(pairs) or original(pairs, *trees))
    out = {r.r: r.K for r in ripley.ripleys_k(as_table(spark, points, x="longitude", y="latitude"), radii).collect()}
    d = gaps(points, points)
    area = np.prod(points.max(0) - points.min(0))
    assert [out[r] for r in radii] == pytest.approx([((d <= r) & (d > 0)).sum() / (len(points) / area * len(points)) for r in radii])
    # What boxes can settle, by brute force over all pairs of blocks.
    tree = block_tree.Tree(blocks.point_blocks(as_table(spark, points).withColumn("w", F.lit(1)), "x", "y", "w", 8), F.col("n"))
    boxes = np.array(tree.boxes.select("min_x", "min_y", "max_x", "max_y").collect())
    low, high = block_tree.gaps([boxes[:, None, c] for c in range(4)], [boxes[None, :, c] for c in range(4)])
    first, last = np.searchsorted(radii, low), np.searchsorted(radii, high)
    undecided = (first < 3) & ~((first == last) & (low > 0)) | np.eye(len(boxes), dtype=bool)
    assert met[0].count() == np.triu(undecided).sum() < 0.5 * len(boxes) * (len(boxes) + 1) / 2


def test_whole_blocks_count_by_their_weights(spark, tall, monkeypatch):
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    points = crowd()
    met = []
    original = joins.with_points
    monkeypatch.setattr(joins, "with_points", lambda pairs, *trees: met.append(pairs) or original(pairs, *trees))
    for radius in (0.01, 2.0, 50.0):
        got = {r.query_id: r.neighbours for r in joins.count_within(as_table(spark, points), as_table(spark, points), radius).collect()}
        assert [got[i] for i in range(len(points))] == (gaps(points, points) <= radius).sum(axis=1).tolist()
    assert met[-1].count() == 0


def test_different_heights(spark, tall, monkeypatch):
    """One block on one side, a tree of several levels on the other."""
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    points = crowd()
    few = points[:5]
    for a, b in ((few, points), (points, few)):
        got = {r.query_id: r.neighbours for r in joins.count_within(as_table(spark, a), as_table(spark, b), 1.0).collect()}
        assert [got[i] for i in range(len(a))] == (gaps(a, b) <= 1.0).sum(axis=1).tolist()


@pytest.mark.parametrize("small", [0, 4096])
def test_neighbours_in_a_crowd(monkeypatch, spark, small):
    """Half of the points in one place: blocks meet few others, and tasks stay bounded."""
    monkeypatch.setattr(blocks, "SMALL_BOXES", small)
    monkeypatch.setattr(joins, "SMALL_QUERIES", 0)
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    points, queries = crowd(), crowd(120)
    met = []
    original = joins.nearest_pairs
    monkeypatch.setattr(joins, "nearest_pairs", lambda *a: met.append(original(*a)) or met[-1])
    out = joins.nearest_neighbours(as_table(spark, queries), as_table(spark, points), 3).collect()
    got = {(r.query_id, r.rank): r.distance for r in out}
    want = np.sort(gaps(queries, points), axis=1)[:, :3]
    assert [[got[i, n + 1] for n in range(3)] for i in range(len(queries))] == pytest.approx(want)
    # Blocks of queries in the crowd meet no block away from it, and no group of partners is large.
    tree = block_tree.Tree(blocks.point_blocks(as_table(spark, queries), "x", "y", "id", 8), F.col("n"))
    crowded = {r.node for r in tree.boxes.filter("max_x - min_x < 0.01").collect()}
    assert len(crowded) >= 5 and all(r.gap < 0.01 for r in met[0].collect() if r.a_id in crowded)
    assert met[0].groupBy("a_id", "part").count().agg(F.max("count")).first()[0] <= 1.5 * blocks.PARTNERS_PER_TASK


def test_more_neighbours_than_points(spark, tall, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_QUERIES", 0)
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    points = mixed_points(40, 3)
    out = joins.nearest_neighbours(as_table(spark, points), as_table(spark, points), 60)
    assert out.count() == 40 * 40
    assert joins.nearest_neighbours(as_table(spark, points), as_table(spark, points).limit(0), 2).count() == 0


def test_tiles_bound_how_often_blocks_travel(spark, monkeypatch):
    """Many blocks are few tiles, so a block goes to few groups; the boxes in a task decide as those of the blocks did."""
    for module, name, value in ((ripley, "RIPLEY_BLOCK", 8), (ripley, "RIPLEY_TILES", 4), (joins, "SEARCH_BLOCK", 8), (joins, "COUNT_TILES", 4)):
        monkeypatch.setattr(module, name, value)
    points = np.vstack([crowd(), crowd()[:40], crowd()[:1].repeat(200, axis=0)])
    met = []
    for module in (ripley, joins):
        monkeypatch.setattr(module, "with_points", lambda pairs, *rest, own=module.with_points: met.append(pairs) or own(pairs, *rest))
    radii = np.array([0.0001, 0.1, 0.5, 1.5])
    d = gaps(points, points)
    area = np.prod(points.max(0) - points.min(0))
    out = {r.r: r.K for r in ripley.ripleys_k(as_table(spark, points, x="longitude", y="latitude"), radii).collect()}
    assert [out[r] for r in radii] == pytest.approx([((d <= r) & (d > 0)).sum() / (len(points) / area * len(points)) for r in radii])
    got = {r.query_id: r.neighbours for r in joins.count_within(as_table(spark, points), as_table(spark, points), 0.5).collect()}
    assert [got[i] for i in range(len(points))] == (d <= 0.5).sum(axis=1).tolist()
    assert met[0].count() <= 16 * 17 / 2 and met[1].count() <= 16 * 24


def test_neighbours_by_tiles(spark, tall, monkeypatch):
    """Blocks of queries that look for neighbours in one group share the blocks of data."""
    monkeypatch.setattr(joins, "SMALL_QUERIES", 0)
    monkeypatch.setattr(joins, "SEARCH_BLOCK", 8)
    monkeypatch.setattr(joins, "tile_bits", lambda blocks, tiles: 3)
    points = crowd()
    out = joins.nearest_neighbours(as_table(spark, points), as_table(spark, points), 4).collect()
    got = {(r.query_id, r.rank): r.distance for r in out}
    want = np.sort(gaps(points, points), axis=1)[:, :4]
    assert [[got[i, n + 1] for n in range(4)] for i in range(len(points))] == pytest.approx(want)


class Points:
    def __init__(self, x, y):
        self.xs, self.ys, self.carried = x, y, np.ones(len(x), "int64")

    def __len__(self):
        return len(self.xs)


@pytest.mark.parametrize("lattice,far,size", [(True, 0.0, 1.0), (False, 0.0, 1.0), (True, 1e6, 1.0), (False, 100.0, 1e-6), (False, -3e8, 1e-3)])
def test_products_of_matrices_count_the_pairs_between_radii_as_distances_do(monkeypatch, lattice, far, size):
    rng = np.random.default_rng(11)
    sides = []
    for shift in (0.0, 2.0):
        x, y = (np.sort(rng.uniform(0, size, 700)) for _ in range(2))
        x = x + shift
        if lattice:  # many distances equal to a radius
            x, y = np.round(x * 40) / 40, np.round(y * 40) / 40
        sides.append(Points(x + far, y + far))
    a, b = sides
    radii = np.asarray([1.0, 2.0, 2.0 + size / 8, 2.5, 5.0])
    radii = np.unique(np.append(radii, np.hypot(a.xs[5] - b.xs[7], a.ys[5] - b.ys[7])))
    seen, products = [], ripley._count_products
    monkeypatch.setattr(ripley, "_count_products", lambda counts, a, b, i, *rest: (seen.append(len(i)), products(counts, a, b, i, *rest)))
    found = ripley._pair_counts(a, b, radii, ripley._between_radii(radii))
    dx, dy = a.xs[:, None] - b.xs[None, :], a.ys[:, None] - b.ys[None, :]
    distance = np.sqrt(dx * dx + dy * dy).ravel()
    want = np.bincount(np.searchsorted(radii, distance, side="left"), minlength=len(radii) + 1)
    assert found[:-1].tolist() == (2 * want[:-1]).tolist()
    assert sum(seen) > 0 or size < 1
