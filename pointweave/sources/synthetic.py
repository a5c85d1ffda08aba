"""Synthetic incidents for demos and tests."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import SEVERITY, lookup

# City centre (longitude, latitude) and sampling weight.
CITIES = {
    "Houston": (-95.37, 29.76, 20), "San Antonio": (-98.49, 29.42, 15), "Dallas": (-96.80, 32.78, 18),
    "Austin": (-97.74, 30.27, 14), "Fort Worth": (-97.33, 32.75, 10), "El Paso": (-106.49, 31.76, 6),
    "Arlington": (-97.11, 32.74, 5), "Corpus Christi": (-97.40, 27.80, 4), "Lubbock": (-101.85, 33.58, 4),
    "Laredo": (-99.51, 27.51, 4),
}
# Offense and sampling weight.
OFFENSES = {
    "Burglary": 12, "Larceny-Theft": 30, "Motor Vehicle Theft": 10, "Aggravated Assault": 15, "Robbery": 8, "Rape": 4,
    "Murder": 1, "Simple Assault": 10, "Drug Offense": 6, "Vandalism": 4,
}
SPREAD_DEGREES = (0.15, 0.10)
FIRST_YEAR, YEARS = 2018, 5


def weighted_choice(draw: Column, weights: dict[str, float]) -> Column:
    """Name whose cumulative share of the weights first exceeds a uniform draw."""
    total = sum(weights.values())
    names = list(weights)
    choice = F.lit(names[-1])
    for name, upper in reversed(list(zip(names[:-1], accumulate(weights.values())))):
        choice = F.when(draw < upper / total, F.lit(name)).otherwise(choice)
    return choice


def synthetic_incidents(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """Weighted cities and offenses with Gaussian scatter; same distribution on every run of the same seed."""
    centre_lon = {c: v[0] for c, v in CITIES.items()}
    centre_lat = {c: v[1] for c, v in CITIES.items()}
    draws = spark.range(n).select(
        F.col("id").alias("incident_id"),
        F.rand(seed).alias("u_city"), F.randn(seed + 1).alias("g_lon"), F.randn(seed + 2).alias("g_lat"),
        F.rand(seed + 3).alias("u_offense"), F.rand(seed + 4).alias("u_year"))
    named = draws.select(
        "*", weighted_choice(F.col("u_city"), {c: v[2] for c, v in CITIES.items()}).alias("city"),
        weighted_choice(F.col("u_offense"), OFFENSES).alias("offense_type"))
    return named.select(
        (lookup(F.col("city"), centre_lon) + F.col("g_lon") * SPREAD_DEGREES[0]).alias("longitude"),
        (lookup(F.col("city"), centre_lat) + F.col("g_lat") * SPREAD_DEGREES[1]).alias("latitude"),
        "offense_type",
        lookup(F.lower("offense_type"), SEVERITY).cast("int").alias("severity"),
        (F.lit(FIRST_YEAR) + F.floor(F.col("u_year") * YEARS)).cast("int").alias("year"),
        "city", "incident_id")
