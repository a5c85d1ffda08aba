"""The whole batch analysis: load, clean, enrich, persist, analyse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.autocorrelation import getis_ord, global_moran, lisa
from ..operators.binning import hexbins, quadrat_statistics, quadrats
from ..operators.clean import add_category, add_severity, add_temporal_features, clean_incidents, filter_offense
from ..operators.dbscan import run_dbscan
from ..operators.density import kernel_density, with_hotspots
from ..operators.hulls import cluster_hulls
from ..operators.joins import attach_county, counts_on_polygons
from ..operators.kmeans import run_kmeans
from ..operators.ripley import ripleys_k
from ..operators.summaries import county_year_counts, summary_by_offense
from ..operators.trend import mann_kendall, temporal_trend
from ..session import cut
from ..sources.readers import read_incidents, read_processed
from ..sources.synthetic import synthetic_incidents
from ..sources.writers import write_processed

# Areal statistics need at least this many polygons.
MIN_POLYGONS = 4


@dataclass(frozen=True)
class BatchSettings:
    """Settings of the batch run; the operators' own defaults differ in places."""

    years: tuple[int, int] = (2018, 2023)
    offense: str | None = None
    kde_grid: int = 200
    dbscan_eps: float = 0.08
    dbscan_min_pts: int = 8
    kmeans_k: int = 8
    hex_size: float = 0.3
    ripley_r: Sequence[float] = tuple(np.linspace(0.01, 1.5, 30))
    permutations: int = 999


def prepare(spark: SparkSession, folder: str, source: str | DataFrame | None = None,
            settings: BatchSettings = BatchSettings(), date: str | None = None) -> DataFrame:
    """Load (a CSV path, a table, or synthetic data), clean, enrich, write to ``folder`` and read back."""
    if isinstance(source, DataFrame):
        raw = source
    else:
        raw = read_incidents(spark, source) if source else synthetic_incidents(spark)
    clean = clean_incidents(raw, year_min=settings.years[0], year_max=settings.years[1])
    if settings.offense and "offense_type" in clean.columns:
        clean = filter_offense(clean, settings.offense)
    enriched = add_temporal_features(add_category(add_severity(clean)), date)
    write_processed(enriched, folder)
    return read_processed(spark, folder)


def analyse(incidents: DataFrame, counties: DataFrame | None = None,
            settings: BatchSettings = BatchSettings()) -> dict[str, DataFrame]:
    """Every analysis of the batch run by name. Tables are lazy except where an algorithm iterates."""
    grid = quadrats(incidents)
    clusters = run_dbscan(incidents, settings.dbscan_eps, settings.dbscan_min_pts)
    kmeans = run_kmeans(incidents, settings.kmeans_k)
    results = {
        "kde": with_hotspots(kernel_density(incidents, grid_size=settings.kde_grid)),
        "quadrat_cells": grid,
        "quadrat_test": quadrat_statistics(grid),
        "dbscan_points": clusters.points,
        "dbscan_summary": clusters.summary,
        "dbscan_hulls": cluster_hulls(clusters.points, settings.dbscan_eps),
        "kmeans_points": kmeans.points,
        "kmeans_centres": kmeans.centres,
        "kmeans_summary": kmeans.summary,
        "hexbins": hexbins(incidents, cell_size=settings.hex_size),
        "ripley": ripleys_k(incidents, settings.ripley_r),
    }
    if counties is not None and counties.limit(MIN_POLYGONS).count() >= MIN_POLYGONS:
        counted = county_year_counts(attach_county(incidents, counties))
        units = cut(counts_on_polygons(counties, counted))
        local, overall = lisa(units, permutations=settings.permutations)
        results |= {
            "county_counts": units,
            "getis_ord": getis_ord(units, permutations=settings.permutations),
            "lisa": local,
            "lisa_global": overall,
            "moran": global_moran(units),
        }
    if "year" in incidents.columns:
        yearly = incidents.withColumn("offense_count", F.lit(1))
        results |= {"trend": temporal_trend(yearly), "trend_test": mann_kendall(yearly)}
    return results | {"summary": summary_by_offense(incidents, "severity")}
