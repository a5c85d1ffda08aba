import threading
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SMALL
from pointweave.operators import binning, clean, model
from pointweave.plans import analysis, layers, views
from pointweave.sources import synthetic


@pytest.fixture(scope="module")
def incidents(spark):
    df = clean.clean_incidents(synthetic.synthetic_incidents(spark, 1000, seed=7))
    return clean.add_category(clean.add_severity(df)).persist()


@pytest.fixture(scope="module")
def hexes(incidents):
    cells = binning.hexbins(incidents, cell_size=0.5).withColumn("offense_count", F.col("count"))
    return cells.withColumn("GEOID", F.concat_ws("_", "hex_col", "hex_row")).persist()


def test_feature_table(hexes):
    f = model.feature_table(hexes, include_lag=False, extra=["hex_col", "absent"])
    assert f.names == ["area_deg2", "centroid_lon", "centroid_lat", "hex_col"]
    assert f.table.count() == hexes.count() and f.table.columns == ["GEOID", *f.names, "label"]


def test_forest_and_grid(spark, hexes, tmp_path):
    f = model.feature_table(hexes, include_lag=False)
    trained = model.train_random_forest(f, trees=20, max_depth=6, folds=2, scale=True)
    m = trained.metrics.first()
    assert m.cv_rmse_mean >= 0 and m.train_r2 <= 1 and trained.importances.count() == len(f.names)
    grid = model.risk_grid(trained, hexes, 8)
    assert grid.count() == 64 and grid.filter("predicted_count < 0").count() == 0
    assert layers.risk_layer(grid).agg(F.max("weight")).first()[0] == pytest.approx(1.0)
    model.save_model(trained, str(tmp_path / "m"))
    again = model.load_model(spark, str(tmp_path / "m"))
    assert again.feature_names == trained.feature_names and again.metrics.first() == m
    same = model.risk_grid(again, hexes, 8)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, grid.collect()))


def test_boosting(hexes):
    trained = model.train_gradient_boosting(model.feature_table(hexes, include_lag=False), rounds=5, folds=2)
    assert trained.metrics.first().model == "GradientBoosting"


def test_layers(incidents, hexes):
    assert layers.incident_layer(incidents, 50).count() == 50
    heat = layers.heat_layer(incidents, cell=0.1)
    assert heat.agg(F.sum("incidents")).first()[0] == incidents.count()
    composite = layers.composite_layers(incidents, hexes, id="GEOID")
    got = {r["layer"] for r in composite.select("layer").distinct().collect()}
    assert got == {"choropleth", "heat", "incidents", "cities"}
    colours = incidents.sparkSession.range(500).select(layers.number_colour(F.col("id")).alias("c")).collect()
    assert len({r.c for r in colours}) > 450 and all(len(r.c) == 7 for r in colours)


def test_dashboard(spark, incidents):
    d = layers.dashboard(incidents.withColumn("county", F.col("city")), (2018, 2020))
    k = d.kpis.first()
    assert k.incidents == incidents.filter("year <= 2020").count() and (k.year_from, k.year_to) == (2018, 2020)
    assert d.top_counties.count() <= 10 and d.offense_shares.count() <= 8
    assert d.yearly.first().trend is None and d.scatter.count() == min(3000, k.incidents)
    assert layers.dashboard(incidents, (1900, 1901)).kpis.count() == 0
    assert [r.year for r in layers.choices(incidents)["year"].collect()] == [2018, 2019, 2020, 2021, 2022]


def test_batch_analysis(spark, tmp_path):
    settings = analysis.BatchSettings(kde_grid=10, permutations=19, ripley_r=(0.1, 0.5), kmeans_k=3)
    df = analysis.prepare(spark, str(tmp_path), settings=settings)
    out = analysis.analyse(df, views.counties(spark), settings)
    assert {"kde", "quadrat_test", "dbscan_hulls", "kmeans_centres", "hexbins", "ripley", "getis_ord", "lisa", "moran",
            "trend", "summary"} <= set(out)
    for name in ("kde", "dbscan_hulls", "getis_ord", "trend", "summary"):
        assert out[name].count() > 0, name


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["hex_col", "hex_row", "crime_category", "count"] and df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_counties_view(spark):
    assert views.counties(spark).count() == 120 and views.population(spark).count() == 960
    assert views.incidents(spark, SMALL).count() == 1000


def test_model_queries_run_at_the_defaults(spark, monkeypatch):
    import inspect
    from types import SimpleNamespace

    from pointweave.operators import model as m
    from pointweave.plans import catalog

    seen = []
    for name in ("train_random_forest", "train_gradient_boosting", "risk_grid"):
        def record(*args, _of=inspect.signature(getattr(m, name)), **named):
            bound = _of.bind(*args, **named).arguments
            seen.append(sorted(set(bound) - {"features", "trained", "study_area", "id"}))
            return SimpleNamespace(metrics=None, importances=None)
        monkeypatch.setattr(m, name, record)
    for name in ("_features", "cells"):
        monkeypatch.setattr(catalog, name, lambda *_: None)
    monkeypatch.setattr(catalog.layers, "risk_layer", lambda grid: grid)
    for name in ("random_forest_metrics", "gradient_boosting_importances", "risk_grid"):
        catalog.QUERIES[name](spark, "")
    assert seen == [[], [], [], []]


def test_folds_are_fitted_side_by_side(spark):
    """Every fit waits until another one runs."""
    both = threading.Barrier(2)

    class Waiting:
        def fit(self, data):
            both.wait(60)
            return LinearRegression().fit(data)

    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(40).selectExpr("id", "double(id) x", "2.0 * id label"))
    scores = model.cross_validate(data, Waiting(), 2, "id").first()
    assert scores.cv_rmse_mean == pytest.approx(0, abs=1e-6) and scores.cv_r2_mean == pytest.approx(1)
