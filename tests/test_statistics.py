import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_table
from pointweave.functions import special
from pointweave.operators import autocorrelation as A
from pointweave.operators import binning, contiguity, density, ranks, ripley, summaries, trend


def simpson(f, upper, n=20_000):
    t = np.linspace(0, upper, n + 1)
    w = np.where(np.arange(n + 1) % 2 == 1, 4.0, 2.0)
    w[[0, -1]] = 1.0
    return float((w * f(t)).sum() * upper / n / 3)


def test_tail_probabilities(spark):
    """Table values, and integrals of the densities over a wide range of degrees."""
    scores = [1.959963984540054, 0.0, -0.3, 1.2, 5.0, 12.0, 60.0]
    chi = [(3.841458820694124, 1), (18.307038053275146, 10), (399.0, 399), (0.0, 3), (30.0, 399), (700.0, 399), (1e6, 399), (4e4, 40_000)]
    t, df = 2.228138851964939, 10
    pairs = [(t / math.sqrt(df + t * t), df + 2), (0.0, 9), (0.5, 7), (-0.5, 7), (0.003, 60_000), (0.01, 600_000), (1.0, 5), (0.9, 3), (0.4, 2)]
    rows = [("z", float(z), 0.0) for z in scores] + [("c", x, float(k)) for x, k in chi] + [("r", r, float(n)) for r, n in pairs] + [
        (kind, None, 3.0) for kind in "zcr"]
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, x double, n double").withColumn(
        "p", F.when(F.col("kind") == "z", special.normal_p("x")).when(F.col("kind") == "c", special.chi_square_p("x", "n")).otherwise(
            special.correlation_p("x", "n"))).orderBy("i").collect()
    got = [r.p for r in found]
    normal = [math.erfc(abs(z) / math.sqrt(2)) for z in scores]
    assert got[:7] == pytest.approx(normal, rel=1e-11, abs=1e-300)
    assert got[7:9] == pytest.approx([0.05, 0.05], abs=1e-10)
    for p, (x, k) in zip(got[7:15], chi):
        density = lambda v, k=k: np.where(v > 0, np.exp((k / 2 - 1) * np.log(np.maximum(v, 1e-300)) - v / 2 - k / 2 * math.log(2) - math.lgamma(k / 2)), 0)
        if k > 2:
            assert p == pytest.approx(1 - simpson(density, x) if x < 1e5 else 0, abs=1e-9)
    assert got[15] == pytest.approx(0.05, abs=1e-10)
    for p, (r, n) in zip(got[15:24], pairs):
        if n > 2 and abs(r) < 1:
            v, tt = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
            front = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
            assert p == pytest.approx(1 - 2 * simpson(lambda u: front * (1 + u * u / v) ** (-(v + 1) / 2), tt), abs=1e-9)
    assert got[21] == 0.0 and got[23] == 1.0 and got[24:] == [None] * 3


@pytest.fixture(scope="module")
def lattice(spark):
    """A 6 x 6 lattice with a hot corner, its edges by definition and the values."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, (6, 6)).astype(float)
    values[:2, :2] += 20
    rows = [(i * 6 + j, i, j, float(values[i, j])) for i in range(6) for j in range(6)]
    units = binning.square_cells(spark.createDataFrame(rows, "id int, i int, j int, v double"), 1.0, "i", "j")
    units = units.join(spark.createDataFrame(rows, "id int, cx int, cy int, v double"), ["cx", "cy"])
    w = np.array([[1.0 if a != b and abs(a // 6 - b // 6) <= 1 and abs(a % 6 - b % 6) <= 1 else 0.0 for b in range(36)] for a in range(36)])
    return units.select("id", "v", "geometry").persist(), w, values.ravel()


def test_local_g(lattice):
    units, w, x = lattice
    n = len(x)
    star = w + np.eye(n)
    star /= star.sum(1, keepdims=True)
    want = (star @ x - x.mean()) / (x.std() * np.sqrt((n * (star**2).sum(1) - 1) / (n - 1)))
    out = A.getis_ord(units, "v", "id", p_method="normal").orderBy("id").collect()
    assert [r.gi_z_score for r in out] == pytest.approx(want)
    assert out[0].hotspot_99 and A.spot_class(A.getis_ord(units, "v", "id", p_method="normal")).filter("id = 0").first().spot_class == "Hot Spot 99%"
    plain = w / w.sum(1, keepdims=True)
    got = A.local_g(units, contiguity.queen_neighbours(units, "id"), "v", "id", star=False).orderBy("id").collect()
    for i in range(n):
        rest = np.delete(x, i)
        z = (plain[i] @ x - rest.mean()) / (rest.std() * math.sqrt(((n - 1) * (plain[i] ** 2).sum() - 1) / (n - 2)))
        assert got[i].gi_z_score == pytest.approx(z)


def test_moran(lattice):
    units, w, x = lattice
    n, z = len(x), x - x.mean()
    wr = w / w.sum(1, keepdims=True)
    s0, s1 = wr.sum(), ((wr + wr.T) ** 2).sum() / 2
    s2 = ((wr.sum(1) + wr.sum(0)) ** 2).sum()
    i, e = n / s0 * (z @ wr @ z) / (z @ z), -1 / (n - 1)
    v = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    r = A.global_moran(units, "v", "id").first()
    assert (r.I, r.expected, r.variance) == pytest.approx((i, e, v))
    assert r.p_value == pytest.approx(math.erfc(abs(i - e) / math.sqrt(2 * v))) and r.is_clustered
    out = A.local_moran(units, "v", "id", p_method="normal").orderBy("id").collect()
    assert [r.lisa_I for r in out] == pytest.approx(list((n - 1) * z * (wr @ z) / (z @ z)))


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 36, 119, 1000):
        for run in (1, 2):
            got = A._permuted(np.arange(n), n, A._keys(42, 5, run))
            assert sorted(got) == list(range(n))
    first = [A._permuted(np.arange(20), 20, A._keys(42, 0, run))[0] for run in range(1, 2001)]
    counts = np.bincount(first, minlength=20)
    assert ((counts - 100) ** 2 / 100).sum() < 45  # chi-square with 19 degrees of freedom, p about 0.001


def test_permutation_p(monkeypatch, lattice):
    units, w, x = lattice
    found = []
    for bound, batch in ((A.BROADCAST_VALUES, A.DRAWS_PER_BATCH), (0, 300)):
        monkeypatch.setattr(A, "BROADCAST_VALUES", bound)
        monkeypatch.setattr(A, "DRAWS_PER_BATCH", batch)
        local = {r.id: r for r in A.local_moran(units, "v", "id", permutations=199).collect()}
        spots = {r.id: r.gi_p_value for r in A.getis_ord(units, "v", "id", permutations=199).collect()}
        whole = A.global_moran_permutation_p(units, "v", "id", permutations=199).first()
        assert local[0].lisa_quadrant == "HH" and local[0].lisa_p <= 0.02 and whole.p_sim <= 0.05
        assert all(1 / 200 <= r.lisa_p <= 0.505 for r in local.values())
        found.append(({i: r.lisa_p for i, r in local.items()}, spots, whole.p_sim))
    assert found[0] == found[1]
    # Against draws by another generator.
    rng, n = np.random.default_rng(3), len(x)
    for i in range(n):
        others, k = np.delete(x, i), int(w[i].sum())
        means = np.array([rng.choice(others, k, replace=False).mean() for _ in range(2000)])
        larger = (means >= w[i] @ x / k - 1e-12).mean()
        assert found[0][1][i] == pytest.approx(min(larger, 1 - larger), abs=0.12)


def test_permutation_p_does_not_depend_on_partitioning(lattice):
    units, _, _ = lattice
    runs = [sorted((r.id, r.gi_p_value) for r in A.getis_ord(u, "v", "id", permutations=99).collect())
            for u in (units, units.repartition(7, "v"))]
    assert runs[0] == runs[1]


def test_moran_by_type(lattice):
    units, _, x = lattice
    table = units.withColumn("flat", F.lit(1.0)).withColumn("half", F.col("v") / 2).drop("geometry")
    edges = contiguity.queen_neighbours(units, "id")
    out = A.moran_by_type(table, id="id", edges=edges).collect()
    assert {r.crime_type for r in out} == {"v", "half"} and out[0].morans_I == out[1].morans_I


def kde(points, grid, factor=None):
    n = len(points)
    factor = factor or n ** (-1 / 6)
    h = np.cov(points.T) * factor**2
    lo, hi = points.min(0), points.max(0)
    pad = (hi - lo) * 0.05
    gx, gy = np.linspace(lo[0] - pad[0], hi[0] + pad[0], grid), np.linspace(lo[1] - pad[1], hi[1] + pad[1], grid)
    g = np.array([(a, b) for b in gy for a in gx])
    d = g[:, None, :] - points[None, :, :]
    q = np.einsum("gpi,ij,gpj->gp", d, np.linalg.inv(h), d)
    return np.exp(-q / 2).sum(1) / (n * 2 * np.pi * math.sqrt(np.linalg.det(h)))


@pytest.mark.parametrize("factor,shear", [(None, 0.0), (0.05, 0.0), (None, 0.9), (0.2, 30.0)])
def test_kernel_density(spark, cloud, factor, shear):
    points = cloud.copy()
    points[:, 1] += shear * points[:, 0]
    df = as_table(spark, points, x="longitude", y="latitude")
    surface = density.kernel_density(df, grid_size=15, bandwidth=factor).orderBy("gy", "gx").collect()
    want = kde(points, 15, factor)
    assert [r.density for r in surface] == pytest.approx(want, rel=1e-9, abs=1e-12 * want.max())


def test_hotspot_share(spark, cloud):
    df = as_table(spark, cloud, x="longitude", y="latitude")
    surface = density.kernel_density(df, grid_size=20).persist()
    marked = density.with_hotspots(surface)
    assert marked.filter("is_hotspot").count() == 40
    row = density.density_summary(df, surface).first()
    assert row.n_points == len(cloud) and row.bandwidth == pytest.approx(len(cloud) ** (-1 / 6))


def test_ripley(spark, cloud):
    radii = np.linspace(0.02, 1.2, 12)
    out = ripley.with_regions(ripley.ripleys_k(as_table(spark, cloud, x="longitude", y="latitude"), radii)).collect()
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    area = np.prod(cloud.max(0) - cloud.min(0))
    want = [((d <= r) & (d > 0)).sum() / (len(cloud) / area * len(cloud)) for r in radii]
    assert [r.K for r in out] == pytest.approx(want)
    assert out[0].L == pytest.approx(math.sqrt(want[0] / math.pi)) and out[0].region == "clustering"


def test_ranks_and_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=300), np.repeat([0.5, -1.0], 60)])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)], "g int, v double")
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.probability): r.percentile for r in ranks.grouped_percentiles(df, ["g"], "v", p).collect()}
    for g in range(3):
        assert [got[g, q] for q in p] == pytest.approx(list(np.percentile(values[g::3], [q * 100 for q in p])))
    order = {r.v: r.average_rank for r in ranks.average_ranks(df, "v").collect()}
    for v in (0.5, -1.0, values[0]):
        assert order[v] == (values < v).sum() + ((values == v).sum() + 1) / 2


def test_correlations(spark):
    rows = [(float(i), float(i * i), float(-i), None if i == 3 else 1.0) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "t double, a double, b double, c double")
    out = {r.var2: r for r in summaries.bivariate_correlation(df, "t", ["a", "b", "absent"]).collect()}
    assert out["a"].spearman_r == 1.0 and out["a"].pearson_r == pytest.approx(0.9763, abs=1e-3) and out["a"].n == 8
    assert out["b"].pearson_r == -1.0 and out["b"].pearson_p == 0.0 and "absent" not in out
    assert summaries.bivariate_correlation(df, "t", ["absent"]).count() == 0
    assert summaries.bivariate_correlation(df, "t", ["c"]).first().pearson_r is None
    matrix = {(r.var1, r.var2): r.correlation for r in summaries.correlation_matrix(df, ["t", "b"]).collect()}
    assert matrix["t", "b"] == pytest.approx(-1.0) and len(matrix) == 4


def test_summary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("b", 5), (None, 9)], "offense_type string, n int")
    out = [tuple(r) for r in summaries.summary_by_offense(df, "n").collect()]
    assert out[0] == ("a", 3, 9, 3.0, 2.0, 2.65, 1, 6) and out[1] == ("b", 1, 5, 5.0, 5.0, None, 5, 5)
    described = {r.statistic: r.value for r in summaries.summary_by_offense(df.drop("offense_type"), "n").collect()}
    assert described["count"] == 5 and described["50%"] == 5 and described["75%"] == 6


def test_risk_score(spark):
    df = spark.createDataFrame([(1, 0.0, "5"), (2, 10.0, "x"), (3, 5.0, "10")], "k int, a double, b string")
    out = {r.k: r.risk_score for r in summaries.risk_score(df, {"a": 1, "b": 1, "absent": 2}).collect()}
    assert out == {1: 12.5, 2: 25.0, 3: 37.5}
    with pytest.raises(ValueError):
        summaries.risk_score(df, {"a": 0})


def series(spark, values):
    return spark.createDataFrame([(2010 + i, v) for i, v in enumerate(values)], "year int, offense_count int")


@pytest.mark.parametrize("values,s,direction", [
    ([1, 2, 3, 4, 5, 6, 7], 21, "increasing"), ([7, 6, 5, 4, 3, 2, 1], -21, "decreasing"),
    ([5, 5, 5, 5], 0, "no trend"), ([3, 1, 4, 1, 5, 9, 2, 6], 11, "no trend")])
def test_mann_kendall(spark, values, s, direction):
    n = len(values)
    assert s == sum(np.sign(values[j] - values[i]) for i in range(n) for j in range(i + 1, n))
    r = trend.mann_kendall(series(spark, values)).first()
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (values.count(v) for v in set(values)))
    assert (r.statistic, r.trend_direction) == (s, direction)
    assert r.variance == pytest.approx((n * (n - 1) * (2 * n + 5) - ties) / 18)


def test_linear_and_rolling(spark):
    r = trend.linear_trend(series(spark, [1, 3, 5, 7])).first()
    assert r.statistic == pytest.approx(2.0) and r.trend_direction == "increasing"
    one = trend.linear_trend(series(spark, [4])).first()
    assert (one.statistic, one.trend_direction) == (0.0, "no trend")
    flat = trend.linear_trend(series(spark, [4, 4, 4])).first()
    assert (flat.statistic, flat.p_value, flat.trend_direction) == (0.0, None, "no trend")
    out = trend.temporal_trend(series(spark, [2, 4, 3, 9]), window=3).collect()
    assert [r.rolling_avg for r in out] == [None, 3.0, pytest.approx(16 / 3), None]
    assert [r.pct_change for r in out] == [None, 100.0, -25.0, 200.0]


def test_quadrats(spark, cloud):
    df = as_table(spark, cloud, x="longitude", y="latitude")
    cells = binning.quadrats(df, n_cols=7, n_rows=5).persist()
    lo, hi = cloud.min(0), cloud.max(0)
    want, _, _ = np.histogram2d(cloud[:, 0], cloud[:, 1], bins=[np.linspace(lo[0], hi[0], 8), np.linspace(lo[1], hi[1], 6)])
    got = np.zeros((7, 5))
    for r in cells.collect():
        got[r.col, r.row] = r["count"]
    assert (got == want).all()
    t = binning.quadrat_statistics(cells).first()
    assert t.vmr == pytest.approx(want.var() / want.mean())
    assert t.chi2_stat == pytest.approx(((want - want.mean()) ** 2 / want.mean()).sum())
    assert 0 <= t.chi2_p <= 1e-6


def test_hexbins(spark, cloud):
    df = as_table(spark, cloud, x="longitude", y="latitude")
    w, h = 0.5, 0.5 * math.sqrt(3) / 2
    out = binning.hexbins(df, cell_size=w).collect()
    keys, counts = np.unique(np.round(cloud / [w, h]).astype(int), axis=0, return_counts=True)
    assert {(r.hex_col, r.hex_row): r["count"] for r in out} == {tuple(k): c for k, c in zip(keys.tolist(), counts)}
    assert all(len(r.geometry[0][0]) == 7 for r in out)
    centres = {(c, r): (c * w + (w / 2 if r % 2 else 0), r * h) for c in range(-6, 7) for r in range(-6, 7)}
    nearest = [min(centres, key=lambda k: (x - centres[k][0]) ** 2 + (y - centres[k][1]) ** 2) for x, y in cloud]
    got = {(r.hex_col, r.hex_row): r["count"] for r in binning.hexbins(df, cell_size=w, mode="nearest").collect()}
    assert got == {k: nearest.count(k) for k in set(nearest)}


def test_correlation_keeps_no_row_per_predictor(spark, monkeypatch):
    """What is written grows with the distinct values of the target, not with rows times predictors."""
    stored = []
    monkeypatch.setattr(summaries, "cut", lambda df, own=summaries.cut: stored.append(own(df)) or stored[-1])
    df = spark.range(300).selectExpr("double(id) t", "id % 7 a", "if(id % 5 = 0, null, id % 11) b", "if(id % 3 = 0, double('NaN'), id * id) c")
    out = {r.var2: r for r in summaries.bivariate_correlation(df, "t", ["a", "b", "c"]).collect()}
    assert {k: r.n for k, r in out.items()} == {"a": 300, "b": 240, "c": 200} and out["c"].spearman_r == 1.0
    assert 0 < max(t.count() for t in stored) <= 300
