"""Predictive models of counts per polygon: features, cross-validated training, risk grids, storage."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import as_double, linspace
from ..functions.geometry import area, bounds, centroid
from .contiguity import queen_neighbours, spatial_lag

SEED = 42
# Largest tree depth MLlib accepts; stands for "unlimited".
MAX_DEPTH = 30
# A fit runs thousands of short jobs, so a partition has many rows, and the fits of all folds run side by side.
PARTITION_ROWS = 20_000
FITS_TOGETHER = 6


class Features(NamedTuple):
    table: DataFrame
    """The id, the feature columns and ``label``."""
    names: list[str]


class TrainedModel(NamedTuple):
    name: str
    model: PipelineModel
    feature_names: list[str]
    scaling: dict[str, tuple[float, float]] | None
    metrics: DataFrame
    """One row: ``model, cv_rmse_mean, cv_rmse_std, cv_r2_mean, train_rmse, train_mae, train_r2``."""
    importances: DataFrame
    """``feature, importance``, highest first."""


def feature_table(polygons: DataFrame, count: str = "offense_count", extra: Sequence[str] | None = None,
                  include_lag: bool = True, id: str = "GEOID", geometry: str = "geometry",
                  edges: DataFrame | None = None) -> Features:
    """Area, centroid, spatial lag and the extra columns that exist; NULL becomes 0."""
    names = ["area_deg2", "centroid_lon", "centroid_lat"]
    middle = centroid(F.col(geometry))
    table = polygons.withColumns({"area_deg2": area(F.col(geometry)), "centroid_lon": middle["x"],
                                  "centroid_lat": middle["y"]})
    if include_lag and count in polygons.columns:
        table = spatial_lag(table, queen_neighbours(polygons, id, geometry) if edges is None else edges, count, id)
        names.append("spatial_lag")
    names += [c for c in extra or () if c in polygons.columns]
    filled = [F.coalesce(as_double(F.col(c)), F.lit(0.0)).alias(c) for c in names]
    label = F.coalesce(as_double(F.col(count)), F.lit(0.0)).alias("label")
    return Features(table.select(id, *filled, label), names)


def _scaled(df: DataFrame, scaling: dict[str, tuple[float, float]] | None) -> DataFrame:
    if not scaling:
        return df
    return df.withColumns({c: (F.col(c) - mean) / (spread or 1.0) for c, (mean, spread) in scaling.items()})


def _scaling(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names)}


def _score(predictions: DataFrame, *metrics: str) -> list[float]:
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    predicted = predictions.select("label", "prediction").persist()
    try:
        return [evaluator.evaluate(predicted, {evaluator.metricName: m}) for m in metrics]
    finally:
        predicted.unpersist()


def _fold_score(data: DataFrame, estimator: Estimator, fold: int) -> tuple[int, float, float] | None:
    training, held_out = data.filter(F.col("fold") != fold).persist(), data.filter(F.col("fold") == fold)
    try:
        if training.isEmpty() or held_out.isEmpty():
            return None
        return fold, *_score(estimator.fit(training).transform(held_out), "rmse", "r2")
    finally:
        training.unpersist()


def _fold_scores(pool: ThreadPool, data: DataFrame, estimator: Estimator, folds: int, id: str, seed: int):
    """Scores of all folds, once they are asked for; the fits are begun at once."""
    folded = data.withColumn("fold", F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(folds)))
    one = inheritable_thread_target(data.sparkSession)(lambda fold: _fold_score(folded, estimator, fold))
    return pool.map_async(one, range(folds), chunksize=1)


def _summarised(data: DataFrame, scores: list) -> DataFrame:
    table = data.sparkSession.createDataFrame([s for s in scores if s is not None], "fold int, rmse double, r2 double")
    return table.agg(F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"), F.avg("r2").alias("cv_r2_mean"))


def cross_validate(data: DataFrame, estimator: Estimator, folds: int, id: str, seed: int = SEED) -> DataFrame:
    """One row: mean and population deviation of the RMSE and mean R2 over folds assigned by a hash of the id."""
    with ThreadPool(FITS_TOGETHER) as pool:
        return _summarised(data, _fold_scores(pool, data, estimator, folds, id, seed).get())


def _train(features: Features, name: str, estimator: Estimator, folds: int, scale: bool, id: str) -> TrainedModel:
    scaling = _scaling(features.table, features.names) if scale else None
    assembler = VectorAssembler(inputCols=features.names, outputCol="features")
    parts = -(-max(1, features.table.count()) // PARTITION_ROWS)
    data = assembler.transform(_scaled(features.table, scaling)).repartition(parts, id).sortWithinPartitions(id).persist()
    try:
        with ThreadPool(FITS_TOGETHER) as pool:
            scores = _fold_scores(pool, data, estimator, folds, id, SEED)
            fitted = estimator.fit(data)
            fit = _score(fitted.transform(data), "rmse", "mae", "r2")
            validation = _summarised(data, scores.get()).first()
    finally:
        data.unpersist()
    spark = features.table.sparkSession
    metrics = spark.createDataFrame(
        [(name, *[None if v is None else float(v) for v in (*validation, *fit)])],
        "model string, cv_rmse_mean double, cv_rmse_std double, cv_r2_mean double, train_rmse double, "
        "train_mae double, train_r2 double")
    importances = spark.createDataFrame(
        list(zip(features.names, map(float, fitted.featureImportances.toArray()))), "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    return TrainedModel(name, PipelineModel([assembler, fitted]), features.names, scaling, metrics, importances)


def train_random_forest(features: Features, trees: int = 200, max_depth: int | None = None, folds: int = 5,
                        scale: bool = False, id: str = "GEOID") -> TrainedModel:
    forest = RandomForestRegressor(numTrees=trees, maxDepth=MAX_DEPTH if max_depth is None else max_depth,
                                   featureSubsetStrategy="all", seed=SEED, cacheNodeIds=True)
    return _train(features, "RandomForest", forest, folds, scale, id)


def train_gradient_boosting(features: Features, rounds: int = 300, rate: float = 0.05, max_depth: int = 4,
                            folds: int = 5, id: str = "GEOID") -> TrainedModel:
    boosting = GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=max_depth, seed=SEED, cacheNodeIds=True)
    return _train(features, "GradientBoosting", boosting, folds, False, id)


def risk_grid(trained: TrainedModel, study_area: DataFrame, grid_size: int = 50, geometry: str = "geometry") -> DataFrame:
    """Predicted counts, never negative, on a regular grid over the bounds of the study area.

    The cell area is the squared longitude step; lag and extra features are 0 on the grid.
    """
    boxes = study_area.select(*[c.alias(n) for n, c in bounds(F.col(geometry)).items()])
    b = boxes.agg(F.min("min_x").alias("x0"), F.max("max_x").alias("x1"), F.min("min_y").alias("y0"),
                  F.max("max_y").alias("y1")).first()
    x0, x1, y0, y1 = (F.lit(float(b[c])) for c in ("x0", "x1", "y0", "y1"))
    step = (b["x1"] - b["x0"]) / max(grid_size - 1, 1)
    cells = study_area.sparkSession.range(grid_size * grid_size).select(
        linspace(F.expr(f"id % {grid_size}"), x0, x1, grid_size).alias("longitude"),
        linspace(F.expr(f"id div {grid_size}"), y0, y1, grid_size).alias("latitude"))
    known = {"centroid_lon": F.col("longitude"), "centroid_lat": F.col("latitude"), "area_deg2": F.lit(step * step)}
    grid = cells.withColumns({c: known.get(c, F.lit(0.0)) for c in trained.feature_names})
    predicted = trained.model.transform(_scaled(grid, trained.scaling))
    return predicted.select("longitude", "latitude", F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_count"))


def scaled_risk(grid: DataFrame, value: str = "predicted_count") -> DataFrame:
    """Values as shares of the largest one; NULL left out."""
    top = grid.agg(F.max(value).alias("top")).scalar()
    return grid.filter(F.col(value).isNotNull()).withColumn("weight", F.col(value) / (top + 1e-9))


def save_model(trained: TrainedModel, path: str) -> str:
    """The fitted pipeline with its metrics, importances, feature names and scaling beside it."""
    spark = trained.metrics.sparkSession
    trained.model.write().overwrite().save(f"{path}/pipeline")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    trained.importances.write.mode("overwrite").parquet(f"{path}/importances")
    rows = [(i, n, *(trained.scaling or {}).get(n, (None, None))) for i, n in enumerate(trained.feature_names)]
    spark.createDataFrame(rows, "place int, feature string, mean double, spread double").write.mode(
        "overwrite").parquet(f"{path}/features")
    return path


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    features = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    metrics = spark.read.parquet(f"{path}/metrics")
    scaling = {r["feature"]: (r["mean"], r["spread"]) for r in features if r["mean"] is not None}
    return TrainedModel(metrics.first()["model"], PipelineModel.load(f"{path}/pipeline"),
                        [r["feature"] for r in features], scaling or None, metrics,
                        spark.read.parquet(f"{path}/importances").orderBy(F.desc("importance"), "feature"))
