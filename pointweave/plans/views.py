"""Views that turn the given tables into located incidents, polygons, populations and series.

The text is plain SQL with integer arithmetic and exponent literals, so that any engine computes the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import rectangle
from ..sources.synthetic import CITIES, OFFENSES

YEARS_FROM, YEARS = 2017, 8
COUNTY_COLS, COUNTY_ROWS = 12, 10
COUNTY_ORIGIN, COUNTY_SIZE = ("-106.65e0", "25.84e0"), ("1.095e0", "1.066e0")


def _values(rows: list[str]) -> str:
    return "VALUES " + ", ".join(f"({i}, {row})" for i, row in enumerate(rows))


# Every 50th event repeats its predecessor, every 101st has no longitude and every 97th lies far outside the area.
INCIDENTS = f"""
SELECT incident_id,
       CASE WHEN sid % 101 = 0 THEN NULL
            ELSE city_lon + ((sid * 7919) % 2003 + (sid * 6101) % 1999 - 2001) * 1.5e-4
                 + CASE WHEN sid % 97 = 0 THEN 5e1 ELSE 0e0 END END AS longitude,
       city_lat + ((sid * 104729) % 2011 + (sid * 4243) % 1997 - 2004) * 1e-4 AS latitude,
       CASE WHEN sid % 3 = 0 THEN concat('  ', upper(offense), ' ') ELSE offense END AS offense_type,
       {YEARS_FROM} + ((sid * 13) % 1013) % {YEARS} AS year,
       city
FROM (SELECT incident_id, sid, (sid * sid) % 10 AS city_no, ((sid * 37) % 1009) % 10 AS offense_no
      FROM (SELECT event_id AS incident_id,
                   CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS sid
            FROM events) AS numbered) AS drawn
JOIN ({_values([f"'{c}', {v[0]}e0, {v[1]}e0" for c, v in CITIES.items()])}) AS cities(cno, city, city_lon, city_lat)
  ON city_no = cno
JOIN ({_values([f"'{o}'" for o in OFFENSES])}) AS offenses(ono, offense) ON offense_no = ono
"""

COUNTIES = f"""
SELECT concat('COUNTY_', CAST(i AS VARCHAR(10)), '_', CAST(j AS VARCHAR(10))) AS county_name,
       CAST(48000 + i * 10 + j AS VARCHAR(10)) AS "GEOID", i, j,
       {COUNTY_ORIGIN[0]} + i * {COUNTY_SIZE[0]} AS x0, {COUNTY_ORIGIN[0]} + (i + 1) * {COUNTY_SIZE[0]} AS x1,
       {COUNTY_ORIGIN[1]} + j * {COUNTY_SIZE[1]} AS y0, {COUNTY_ORIGIN[1]} + (j + 1) * {COUNTY_SIZE[1]} AS y1
FROM (SELECT range // 10 AS i, range % 10 AS j FROM range(120)) AS lattice
"""

POPULATION = f"""
SELECT county_name AS county, year,
       CASE WHEN i = 0 AND j = 0 THEN 0 ELSE 1000 + (i * 37 + j * 101 + year * 7) % 5000 END AS population
FROM counties, (SELECT {YEARS_FROM} + range AS year FROM range({YEARS})) AS years
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located incidents derived row by row from ``events``."""
    return spark.sql(INCIDENTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def counties(spark: SparkSession) -> DataFrame:
    """Regular lattice of 120 county rectangles; neighbours share bit-equal corners."""
    text = COUNTIES.replace('"GEOID"', "GEOID").replace("SELECT range // 10 AS i, range % 10 AS j FROM range(120)",
                                                        "SELECT id DIV 10 AS i, id % 10 AS j FROM range(120)")
    df = spark.sql(text)
    return df.withColumn("geometry", rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


def population(spark: SparkSession) -> DataFrame:
    """People per county and year; the years are unfolded per row, so no join is needed."""
    years = F.sequence(F.lit(YEARS_FROM).cast("bigint"), F.lit(YEARS_FROM + YEARS - 1).cast("bigint"))
    i, j, year = F.col("i"), F.col("j"), F.col("year")
    people = F.when((i == 0) & (j == 0), F.lit(0)).otherwise(1000 + (i * 37 + j * 101 + year * 7) % 5000)
    return counties(spark).select(F.col("county_name").alias("county"), "i", "j", F.explode(years).alias("year")).select(
        "county", "year", people.cast("bigint").alias("population"))


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two components of each embedding as planar points."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))
