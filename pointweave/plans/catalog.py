"""Every registered query with the equivalent SQL over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G
from ..functions.columns import haversine_km, rounded_half_up
from ..operators import autocorrelation, binning, clean, contiguity, dbscan, density, hulls, joins, kmeans, model
from ..operators import ripley, summaries, trend
from ..session import cut, ensure_checkpoint_dir, ship_package
from ..sources import readers, writers
from ..sources.synthetic import CITIES
from . import layers, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_processed: dict[tuple[str, str], DataFrame] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and enriched incidents, written once per application as the batch flow does and then shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _processed:
        _processed[key] = cut(clean.add_category(clean.add_severity(clean.clean_incidents(views.incidents(spark, sf_dir)))))
    return _processed[key]


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# SQL building blocks ---------------------------------------------------------------------------------------------

_SEVERITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in clean.SEVERITY.items())
_IN = {name: ", ".join(f"'{o}'" for o in group) for name, group in
       (("violent", clean.VIOLENT), ("property", clean.PROPERTY))}
INCIDENTS = f"incidents AS MATERIALIZED ({views.INCIDENTS})"
CLEAN = INCIDENTS + """, clean AS MATERIALIZED (
SELECT incident_id, longitude, latitude,
       regexp_replace(regexp_replace(lower(offense_type), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS offense_type, year, city
FROM (SELECT *, row_number() OVER (PARTITION BY longitude, latitude, offense_type, year ORDER BY incident_id) AS nth
      FROM incidents WHERE longitude BETWEEN -106.65e0 AND -93.51e0 AND latitude BETWEEN 25.84e0 AND 36.50e0) AS t
WHERE nth = 1 AND year BETWEEN 2010 AND 2024)"""
ENRICHED = CLEAN + f""", enriched AS MATERIALIZED (
SELECT *, CAST(CASE offense_type {_SEVERITY} ELSE 3 END AS INTEGER) AS severity,
       CASE WHEN offense_type IN ({_IN["violent"]}) THEN 'violent'
            WHEN offense_type IN ({_IN["property"]}) THEN 'property' ELSE 'other' END AS crime_category
FROM clean)"""
COUNTIES = f"counties AS MATERIALIZED ({views.COUNTIES})"
LOCATED = f"""{CLEAN}, {COUNTIES}, located AS MATERIALIZED (
SELECT p.*, c.county_name AS county, c."GEOID" AS geoid FROM clean AS p LEFT JOIN counties AS c
ON p.longitude > c.x0 AND p.longitude < c.x1 AND p.latitude > c.y0 AND p.latitude < c.y1)"""
POPULATION = f"population AS MATERIALIZED ({views.POPULATION})"

CELL = 0.02
CELLS = ENRICHED + f""", cells AS MATERIALIZED (
SELECT CAST(floor(longitude / {CELL}e0) AS BIGINT) AS cx, CAST(floor(latitude / {CELL}e0) AS BIGINT) AS cy,
       concat(CAST(floor(longitude / {CELL}e0) AS BIGINT), '_', CAST(floor(latitude / {CELL}e0) AS BIGINT)) AS cell_id,
       count(*) AS offense_count, count(*) FILTER (crime_category = 'violent') AS violent,
       count(*) FILTER (crime_category = 'property') AS property, count(*) FILTER (crime_category = 'other') AS other
FROM enriched GROUP BY 1, 2, 3), queen AS MATERIALIZED (
SELECT a.cell_id AS src, b.cell_id AS dst, 1e0 / count(*) OVER (PARTITION BY a.cell_id) AS w,
       1e0 / count(*) OVER (PARTITION BY b.cell_id) AS w_back
FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM cells) AS a0
JOIN (SELECT unnest([-1, 0, 1]) AS dy) AS o ON true
JOIN cells AS a ON a.cell_id = a0.cell_id
JOIN cells AS b ON b.cx = a0.cx + a0.dx AND b.cy = a0.cy + o.dy WHERE a.cell_id <> b.cell_id)"""


def sample_order_sql(seed: int, key: str = "incident_id") -> str:
    return f"md5(concat('{seed}|', CAST({key} AS VARCHAR))), {key}"


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _simpson(density: str, upper: str, steps: int = 4000) -> str:
    """Integral of a density, an expression in ``t``, from 0 to ``upper`` by Simpson's rule."""
    t = f"(k * {upper} / {steps}e0)"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1e0 WHEN k % 2 = 1 THEN 4e0 ELSE 2e0 END"
    return f"({upper} / {3 * steps}e0 * list_sum([{weight} * {density.replace('{t}', t)} FOR k IN range({steps + 1})]))"


def normal_p_sql(z: str) -> str:
    return f"greatest(0e0, 1 - 2 * {_simpson('exp(-{t} * {t} / 2) / sqrt(2 * pi())', f'least(40e0, abs({z}))')})"


def correlation_p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation below 1 over more than two pairs, from Student's density."""
    free = f"({n} - 2e0)"
    t = f"least(60e0, abs({r}) * sqrt({free} / (1 - {r} * {r})))"
    density = f"exp(lgamma(({free} + 1) / 2) - lgamma({free} / 2) - ({free} + 1) / 2 * ln(1 + {{t}} * {{t}} / {free})) / sqrt({free} * pi())"
    return f"greatest(0e0, 1 - 2 * {_simpson(density, t)})"


def chi_square_p_sql(x: str, dof: str) -> str:
    density = f"CASE WHEN k = 0 THEN 0e0 ELSE exp(({dof} / 2e0 - 1) * ln({{t}}) - {{t}} / 2 - {dof} / 2e0 * ln(2e0) - lgamma({dof} / 2e0)) END"
    return f"greatest(0e0, 1 - {_simpson(density, f'least({x}, 20e0 * {dof})')})"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied square cells of the processed incidents: a polygon table that grows with the data."""
    df = processed(spark, sf_dir)
    side = CELL
    counted = cut(df.groupBy(F.floor(F.col("longitude") / side).alias("cx"), F.floor(F.col("latitude") / side).alias("cy")).agg(
        F.count(F.lit(1)).alias("offense_count"), *[F.count_if(F.col("crime_category") == c).alias(c)
                                                    for c in ("violent", "property", "other")]))
    corner = [F.col("cx") * side, F.col("cy") * side, (F.col("cx") + 1) * side, (F.col("cy") + 1) * side]
    return counted.withColumns({"cell_id": F.concat_ws("_", "cx", "cy"), "geometry": G.rectangle(*corner)})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir).select(F.col("incident_id").alias("id"), F.col("longitude").alias("x"),
                                           F.col("latitude").alias("y"))


# Cleaning and enrichment -----------------------------------------------------------------------------------------


@query(sql(CLEAN, "SELECT * FROM clean"))
def clean_incidents(spark, sf_dir):
    return clean.clean_incidents(views.incidents(spark, sf_dir))


@query(sql(ENRICHED, "SELECT crime_category, CAST(floor(longitude / 0.25e0) AS BIGINT) AS x, count(*) AS n "
                     "FROM enriched GROUP BY 1, 2"))
def category_by_longitude(spark, sf_dir):
    df = clean.add_category(clean.add_severity(clean.clean_incidents(views.incidents(spark, sf_dir))))
    return df.groupBy("crime_category", F.floor(F.col("longitude") / 0.25).alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(ENRICHED, "SELECT incident_id, offense_type, severity, crime_category FROM enriched"))
def severity_category(spark, sf_dir):
    return processed(spark, sf_dir).select("incident_id", "offense_type", "severity", "crime_category")


@query("""SELECT l_orderkey, l_linenumber, CAST(month(l_shipdate) AS INTEGER) AS month,
CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week, CAST(hour(l_shipdate) AS INTEGER) AS hour,
CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
     WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM lineitem""")
def temporal_features(spark, sf_dir):
    df = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return clean.add_temporal_features(df, "l_shipdate").drop("l_shipdate")


_CITY = "CASE city " + " ".join(f"WHEN '{c}' THEN {{}}".format(f"{v[0]}e0") for c, v in CITIES.items()) + " END"
_CITY_LAT = "CASE city " + " ".join(f"WHEN '{c}' THEN {v[1]}e0" for c, v in CITIES.items()) + " END"


@query(sql(CLEAN, f"""SELECT incident_id, round(2 * 6371e0 * asin(sqrt(least(a, 1e0))), 6) AS km_asin,
round(2 * 6371e0 * atan2(sqrt(least(a, 1e0)), sqrt(1e0 - least(a, 1e0))), 6) AS km_atan2 FROM (
SELECT incident_id, pow(sin(radians({_CITY_LAT} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({_CITY_LAT}))
* pow(sin(radians({_CITY} - longitude) / 2), 2) AS a FROM clean) AS t"""))
def haversine_to_city(spark, sf_dir):
    lon = clean.lookup(F.col("city"), {c: v[0] for c, v in CITIES.items()})
    lat = clean.lookup(F.col("city"), {c: v[1] for c, v in CITIES.items()})
    pair = (F.col("longitude"), F.col("latitude"), lon, lat)
    return processed(spark, sf_dir).select("incident_id", F.round(haversine_km(*pair), 6).alias("km_asin"),
                                           F.round(haversine_km(*pair, form="atan2"), 6).alias("km_atan2"))


@query(sql(CLEAN, "SELECT offense_type, count(*) AS n FROM clean WHERE regexp_matches(offense_type, '(?i)ASSAULT|theft') "
                  "GROUP BY 1"))
def offense_filter(spark, sf_dir):
    chosen = clean.filter_offense(processed(spark, sf_dir), "ASSAULT|theft")
    return chosen.groupBy("offense_type").agg(F.count(F.lit(1)).alias("n"))


@query(sql(CLEAN, "SELECT incident_id, year, city FROM clean WHERE year BETWEEN 2019 AND 2021 AND offense_type = 'robbery'"))
def selection_filter(spark, sf_dir):
    return clean.filter_selection(processed(spark, sf_dir), (2019, 2021), "robbery").select("incident_id", "year", "city")


# Summaries -------------------------------------------------------------------------------------------------------


def _summary_sql(ctes: str, table: str, key: str, value: str, whole: bool) -> str:
    keep = (lambda c: c) if whole else (lambda c: f"round_even({c}, 2)")
    total = f"CAST(sum({value}) AS BIGINT)" if whole else f"round_even(sum({value}), 2)"
    return f"""{"WITH " + ctes if ctes else ""} SELECT {key} AS offense_type, count({value}) AS n_areas, {total} AS total,
round_even(avg({value}), 2) AS mean, round_even(median(CAST({value} AS DOUBLE)), 2) AS median,
round_even(stddev_samp({value}), 2) AS std, {keep(f"min({value})")} AS min, {keep(f"max({value})")} AS max
FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"""


@query(_summary_sql(ENRICHED, "enriched", "offense_type", "severity", True))
def summary_by_offense(spark, sf_dir):
    return summaries.summary_by_offense(processed(spark, sf_dir), "severity")


@query(_summary_sql("", "lineitem", "l_returnflag", "l_extendedprice", False))
def summary_of_prices(spark, sf_dir):
    return summaries.summary_by_offense(views.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")


@query("""WITH s AS (SELECT count(l_extendedprice) AS n, avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS d,
min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT unnest(['count', 'mean', 'std', 'min', 'max', '25%', '50%', '75%']) AS statistic,
       round(unnest([n, a, d, lo, hi, q[1], q[2], q[3]]), 4) AS value FROM s""")
def describe_prices(spark, sf_dir):
    return rounded(summaries.describe_column(views.table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4, "value")


@query(sql(CLEAN, "SELECT offense_type, count(*) AS count FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_offenses(spark, sf_dir):
    return summaries.top_values(processed(spark, sf_dir), "offense_type", 5)


@query(sql(CLEAN, """, top AS (SELECT offense_type, count(*) AS count FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT array_to_string(list_transform(string_split(offense_type, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')
AS offense_type, count, round(count / (SELECT sum(count) FROM top), 6) AS share FROM top"""))
def offense_shares(spark, sf_dir):
    return rounded(summaries.offense_shares(processed(spark, sf_dir)), 6, "share")


@query(sql(CLEAN, "SELECT city, count(*) AS count FROM clean GROUP BY 1"))
def city_counts(spark, sf_dir):
    return summaries.frequencies(processed(spark, sf_dir), "city")


@query(sql(CLEAN, "SELECT DISTINCT offense_type FROM clean"))
def offense_choices(spark, sf_dir):
    return summaries.distinct_choices(processed(spark, sf_dir), "offense_type")


@query(sql(LOCATED, "SELECT county, year, count(*) AS offense_count FROM located WHERE county IS NOT NULL GROUP BY 1, 2"))
def county_year_counts(spark, sf_dir):
    return summaries.county_year_counts(joins.attach_county(processed(spark, sf_dir), views.counties(spark)))


@query(sql(LOCATED, """, n AS (SELECT county, offense_type, count(*) AS rows FROM located WHERE county IS NOT NULL GROUP BY 1, 2)
SELECT county, CAST(sum(rows) AS BIGINT) AS total, (list(offense_type ORDER BY rows DESC, offense_type))[1] AS top_crime
FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def top_counties(spark, sf_dir):
    return summaries.top_counties(joins.attach_county(processed(spark, sf_dir), views.counties(spark)))


@query(sql(CLEAN, """, s AS (SELECT * FROM clean WHERE year BETWEEN 2018 AND 2022)
SELECT count(*) AS incidents, (SELECT city FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_city,
(SELECT array_to_string(list_transform(string_split(offense_type, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')
 FROM s GROUP BY offense_type ORDER BY count(*) DESC, offense_type LIMIT 1) AS top_crime,
CAST(2018 AS BIGINT) AS year_from, CAST(2022 AS BIGINT) AS year_to FROM s"""))
def kpi_row(spark, sf_dir):
    chosen = clean.filter_selection(processed(spark, sf_dir), (2018, 2022))
    return summaries.kpi_row(chosen, (2018, 2022))


@query(sql(CLEAN, """SELECT round(a - (b - a) * 0.05e0, 9) AS min_lon, round(b + (b - a) * 0.05e0, 9) AS max_lon,
round(c - (d - c) * 0.05e0, 9) AS min_lat, round(d + (d - c) * 0.05e0, 9) AS max_lat
FROM (SELECT min(longitude) AS a, max(longitude) AS b, min(latitude) AS c, max(latitude) AS d FROM clean) AS t"""))
def bounding_box(spark, sf_dir):
    return rounded(summaries.bounding_box(processed(spark, sf_dir), pad=0.05), 9, "min_lon", "max_lon", "min_lat", "max_lat")


@query("""SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) /
((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS scaled FROM customer""")
def min_max_scale(spark, sf_dir):
    df = views.table(spark, sf_dir, "customer")
    return df.select("c_custkey", F.round(summaries.min_max_scaled(df, ["c_acctbal"])["c_acctbal"], 6).alias("scaled"))


def _nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("c_acctbal").alias("balance"))
    sellers = views.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("suppliers"))
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey"))
    return nations.join(people, "n_nationkey", "left").join(sellers, "n_nationkey", "left")


@query("""WITH u AS (SELECT n_nationkey, coalesce(accounts, 0) AS accounts, coalesce(balance, 0e0) AS balance,
coalesce(suppliers, 0) AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS accounts, sum(c_acctbal) AS balance FROM customer GROUP BY 1) AS c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) AS s ON s_nationkey = n_nationkey),
m AS (SELECT min(accounts) AS a0, max(accounts) AS a1, min(balance) AS b0, max(balance) AS b1, min(suppliers) AS s0,
max(suppliers) AS s1 FROM u)
SELECT n_nationkey, round_even(100 * (CASE WHEN a1 = a0 THEN 0e0 ELSE (accounts - a0) / CAST(a1 - a0 AS DOUBLE) * 0.5e0 END
+ CASE WHEN b1 = b0 THEN 0e0 ELSE (balance - b0) / (b1 - b0) * 0.3e0 END
+ CASE WHEN s1 = s0 THEN 0e0 ELSE (suppliers - s0) / CAST(s1 - s0 AS DOUBLE) * 0.1e0 END), 2) AS risk_score FROM u, m""")
def risk_score(spark, sf_dir):
    units = _nation_units(spark, sf_dir)
    scored = summaries.risk_score(units, {"accounts": 5.0, "balance": 3.0, "suppliers": 1.0, "absent": 1.0})
    return scored.select("n_nationkey", "risk_score")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
                          for a in _MEASURES for b in _MEASURES))
def correlation(spark, sf_dir):
    return rounded(summaries.correlation_matrix(views.table(spark, sf_dir, "lineitem"), _MEASURES), 6, "correlation")


_RANKS = ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0e0 AS r_{m}" for m in _MEASURES)


@query(f"WITH r AS (SELECT *, {_RANKS} FROM lineitem), c AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT 'l_extendedprice' AS var1, '{m}' AS var2, corr(l_extendedprice, {m}) AS pr, "
    f"corr(r_l_extendedprice, r_{m}) AS sr, count(*) AS n FROM r" for m in _MEASURES if m != "l_extendedprice")
    + f""") SELECT var1, var2, round_even(pr, 4) AS pearson_r, round_even({correlation_p_sql("pr", "n")}, 4) AS pearson_p,
round_even(sr, 4) AS spearman_r, round_even({correlation_p_sql("sr", "n")}, 4) AS spearman_p, n FROM c""")
def bivariate_correlation(spark, sf_dir):
    others = [m for m in _MEASURES if m != "l_extendedprice"]
    return summaries.bivariate_correlation(views.table(spark, sf_dir, "lineitem"), "l_extendedprice", others)


@query(sql(CLEAN, "SELECT count(*) AS available, least(count(*), 2000) AS shown FROM clean"))
def sample_size(spark, sf_dir):
    df = processed(spark, sf_dir)
    shown = summaries.fixed_sample(df.select("incident_id"), 2000, "incident_id").agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count(F.lit(1)).alias("available")).withColumn("shown", shown)


@query(sql(ENRICHED, f"""SELECT incident_id, longitude, latitude, offense_type, year, city, severity, crime_category FROM enriched
ORDER BY {sample_order_sql(42)} LIMIT 2000"""))
def sample_points(spark, sf_dir):
    return summaries.fixed_sample(processed(spark, sf_dir), 2000, "incident_id").select(
        "incident_id", "longitude", "latitude", "offense_type", "year", "city", "severity", "crime_category")


# Binning ---------------------------------------------------------------------------------------------------------

_HEX = 0.25
_HEX_ROW = repr(_HEX * float(np.sqrt(3)) / 2) + "e0"


@query(sql(ENRICHED, f"""SELECT CAST(round_even(longitude / {_HEX}e0, 0) AS BIGINT) AS hex_col,
CAST(round_even(latitude / {_HEX_ROW}, 0) AS BIGINT) AS hex_row, crime_category, count(*) AS count FROM enriched GROUP BY 1, 2, 3"""))
def hexbins_by_category(spark, sf_dir):
    return binning.hexbins(processed(spark, sf_dir), cell_size=_HEX, by=("crime_category",)).drop("geometry").orderBy(
        F.desc("count"), "hex_col", "hex_row", "crime_category")


@query(sql(CLEAN, f"""SELECT CAST(round_even(longitude / {_HEX}e0, 0) AS BIGINT) AS hex_col,
CAST(round_even(latitude / {_HEX_ROW}, 0) AS BIGINT) AS hex_row, count(*) AS count FROM clean GROUP BY 1, 2"""))
def hexbins(spark, sf_dir):
    return binning.hexbins(processed(spark, sf_dir), cell_size=_HEX).drop("geometry")


@query(sql(CLEAN, f""", p AS (SELECT longitude AS x, latitude AS y, CAST(floor(latitude / {_HEX_ROW}) AS BIGINT) + k AS r, k
FROM clean, (SELECT unnest([0, 1]) AS k) AS ks), c AS (
SELECT x, y, r, CAST(round_even((x - CASE WHEN (r % 2 + 2) % 2 = 1 THEN {_HEX / 2}e0 ELSE 0e0 END) / {_HEX}e0, 0) AS BIGINT) AS q, k FROM p),
d AS (SELECT k, q, r, pow(x - (q * {_HEX}e0 + CASE WHEN (r % 2 + 2) % 2 = 1 THEN {_HEX / 2}e0 ELSE 0e0 END), 2) + pow(y - r * {_HEX_ROW}, 2) AS g, x, y
FROM c), w AS (SELECT a.q AS q0, a.r AS r0, b.q AS q1, b.r AS r1, a.g AS g0, b.g AS g1 FROM
(SELECT *, row_number() OVER (ORDER BY x, y) AS i FROM d WHERE k = 0) AS a JOIN
(SELECT *, row_number() OVER (ORDER BY x, y) AS i FROM d WHERE k = 1) AS b ON a.i = b.i)
SELECT CASE WHEN g0 <= g1 THEN q0 ELSE q1 END AS hex_col, CASE WHEN g0 <= g1 THEN r0 ELSE r1 END AS hex_row, count(*) AS count FROM w GROUP BY 1, 2"""))
def hexbins_nearest(spark, sf_dir):
    return binning.hexbins(processed(spark, sf_dir), cell_size=_HEX, mode="nearest").drop("geometry")


QUADRATS = CLEAN + """, b AS (SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1 FROM clean),
lon_edge AS (SELECT CAST(range AS INTEGER) AS i, range * ((x1 - x0) / 20e0) + x0 AS lo,
CASE WHEN range = 19 THEN x1 ELSE (range + 1) * ((x1 - x0) / 20e0) + x0 END AS hi FROM range(20), b),
lat_edge AS (SELECT CAST(range AS INTEGER) AS j, range * ((y1 - y0) / 20e0) + y0 AS lo,
CASE WHEN range = 19 THEN y1 ELSE (range + 1) * ((y1 - y0) / 20e0) + y0 END AS hi FROM range(20), b),
quadrats AS MATERIALIZED (SELECT x.i AS col, y.j AS row, count(p.incident_id) AS count FROM lon_edge AS x CROSS JOIN lat_edge AS y LEFT JOIN clean AS p
ON p.longitude >= x.lo AND (p.longitude < x.hi OR (x.i = 19 AND p.longitude <= x.hi))
AND p.latitude >= y.lo AND (p.latitude < y.hi OR (y.j = 19 AND p.latitude <= y.hi)) GROUP BY 1, 2)"""


@query(sql(QUADRATS, "SELECT * FROM quadrats"))
def quadrat_counts(spark, sf_dir):
    return binning.quadrats(processed(spark, sf_dir)).drop("geometry")


@query(sql(CLEAN, f"""SELECT hex_col, hex_row, count, CAST(len(xs) AS INTEGER) AS corners, round(xs[1], 6) AS first_x, round(ys[1], 6) AS first_y,
round(list_min(xs), 6) AS west, round(list_max(xs), 6) AS east, round(list_min(ys), 6) AS south, round(list_max(ys), 6) AS north,
round(list_sum([xs[i] * ys[i + 1] - xs[i + 1] * ys[i] FOR i IN range(1, 7)]) / 2, 6) AS area
FROM (SELECT *, [x + {_HEX / 2}e0 * cos(k % 6 * pi() / 3) FOR k IN range(7)] AS xs, [y + {_HEX / 2}e0 * sin(k % 6 * pi() / 3) FOR k IN range(7)] AS ys
FROM (SELECT hex_col, hex_row, count, hex_col * {_HEX}e0 + CASE WHEN (hex_row % 2 + 2) % 2 = 1 THEN {_HEX / 2}e0 ELSE 0e0 END AS x, hex_row * {_HEX_ROW} AS y
FROM (SELECT CAST(round_even(longitude / {_HEX}e0, 0) AS BIGINT) AS hex_col, CAST(round_even(latitude / {_HEX_ROW}, 0) AS BIGINT) AS hex_row,
count(*) AS count FROM clean GROUP BY 1, 2) AS h) AS c) AS r"""))
def hexbin_shapes(spark, sf_dir):
    """The drawn hexagons: corners, extent and area."""
    table = binning.hexbins(processed(spark, sf_dir), cell_size=_HEX)
    b, ring = G.bounds(F.col("geometry")), F.col("geometry")[0][0]
    return table.select("hex_col", "hex_row", "count", F.size(ring).alias("corners"), *[
        F.round(c, 6).alias(n) for n, c in (("first_x", ring[0]["x"]), ("first_y", ring[0]["y"]), ("west", b["min_x"]), ("east", b["max_x"]),
                                            ("south", b["min_y"]), ("north", b["max_y"]), ("area", G.area(F.col("geometry"))))])


@query(sql(QUADRATS, """SELECT q.col, q.row, q.count, round(x.lo, 9) AS west, round(x.hi, 9) AS east, round(y.lo, 9) AS south, round(y.hi, 9) AS north,
round((x.hi - x.lo) * (y.hi - y.lo), 9) AS area FROM quadrats AS q JOIN lon_edge AS x ON x.i = q.col JOIN lat_edge AS y ON y.j = q.row"""))
def quadrat_shapes(spark, sf_dir):
    table = binning.quadrats(processed(spark, sf_dir))
    b = G.bounds(F.col("geometry"))
    return table.select("col", "row", "count", *[F.round(c, 9).alias(n) for n, c in (
        ("west", b["min_x"]), ("east", b["max_x"]), ("south", b["min_y"]), ("north", b["max_y"]), ("area", G.area(F.col("geometry"))))])


@query(sql(QUADRATS, f"""SELECT round(x, 4) AS chi2_stat, round({chi_square_p_sql("x", "dof")}, 9) AS chi2_p, round(vmr, 6) AS vmr
FROM (SELECT sum(pow(count - m, 2) / (m + 1e-9)) AS x, count(*) - 1 AS dof, var_pop(count) / avg(count) AS vmr
FROM quadrats, (SELECT avg(count) AS m FROM quadrats) AS t) AS u"""))
def quadrat_test(spark, sf_dir):
    table = binning.quadrat_statistics(binning.quadrats(processed(spark, sf_dir)))
    return rounded(rounded(rounded(table, 4, "chi2_stat"), 9, "chi2_p"), 6, "vmr")


@query(f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS count FROM orders GROUP BY 1),
u AS (SELECT sum(pow(count - m, 2) / (m + 1e-9)) AS x, count(*) - 1 AS dof, var_pop(count) / avg(count) AS vmr
FROM days, (SELECT avg(count) AS m FROM days) AS t)
SELECT round(x, 4) AS chi2_stat, round({chi_square_p_sql("x", "dof")}, 9) AS chi2_p, round(vmr, 6) AS vmr FROM u""")
def dispersion_of_orders(spark, sf_dir):
    """The same test on orders per day, which are spread evenly enough for a p-value between 0 and 1."""
    days = views.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("count"))
    return rounded(rounded(rounded(binning.quadrat_statistics(days), 4, "chi2_stat"), 9, "chi2_p"), 6, "vmr")


# Trends and rates ------------------------------------------------------------------------------------------------

YEARLY = "yearly AS MATERIALIZED (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1)"


def _orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.lit(1).alias("offense_count"))


@query(sql(YEARLY, """SELECT year, count, round((count / CAST(lag(count) OVER (ORDER BY year) AS DOUBLE) - 1) * 100, 6) AS pct_change,
round(CASE WHEN count(*) OVER w = 3 THEN avg(count) OVER w END, 6) AS rolling_avg
FROM yearly WINDOW w AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def yearly_trend(spark, sf_dir):
    return rounded(trend.temporal_trend(_orders_by_year(spark, sf_dir)), 6, "pct_change", "rolling_avg")


@query(sql(YEARLY, """, s AS (SELECT CAST(coalesce(sum(sign(b.count - a.count)), 0) AS DOUBLE) AS s FROM yearly AS a JOIN yearly AS b ON a.year < b.year),
v AS (SELECT (n * (n - 1) * (2 * n + 5) - t) / 18e0 AS v FROM (SELECT count(*) AS n FROM yearly) AS a,
(SELECT sum(k * (k - 1) * (2 * k + 5)) AS t FROM (SELECT count(*) AS k FROM yearly GROUP BY count) AS g) AS b)
SELECT statistic, round(v, 6) AS variance, round(z, 6) AS z, round(p, 9) AS p_value, CASE WHEN z > 0 AND p < 0.05 THEN 'increasing'
WHEN z < 0 AND p < 0.05 THEN 'decreasing' ELSE 'no trend' END AS trend_direction
FROM (SELECT *, """ + normal_p_sql("z") + """ AS p FROM (SELECT s AS statistic, v, CASE WHEN s = 0 THEN 0e0 ELSE (s - sign(s)) / sqrt(v) END AS z
FROM s, v) AS scored) AS tested"""))
def mann_kendall(spark, sf_dir):
    return rounded(rounded(trend.mann_kendall(_orders_by_year(spark, sf_dir)), 6, "variance", "z"), 9, "p_value")


@query(sql(YEARLY, """SELECT round(slope, 6) AS statistic, round(p, 9) AS p_value, CASE WHEN slope > 0 AND p < 0.05 THEN 'increasing'
WHEN slope < 0 AND p < 0.05 THEN 'decreasing' ELSE 'no trend' END AS trend_direction FROM (SELECT slope, """ + correlation_p_sql("r", "n") + """ AS p
FROM (SELECT regr_slope(count, x) AS slope, corr(count, x) AS r, count(*) AS n
FROM (SELECT count, row_number() OVER (ORDER BY year) - 1 AS x FROM yearly) AS t) AS fit) AS tested"""))
def linear_trend(spark, sf_dir):
    return rounded(rounded(trend.linear_trend(_orders_by_year(spark, sf_dir)), 6, "statistic"), 9, "p_value")


@query(sql(CLEAN, """SELECT year, n AS count, round(CASE WHEN count(*) OVER w = 2 THEN avg(n) OVER w END, 6) AS trend
FROM (SELECT year, count(*) AS n FROM clean GROUP BY 1) AS t WINDOW w AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"""))
def yearly_counts(spark, sf_dir):
    return layers.dashboard(processed(spark, sf_dir), (2010, 2024)).yearly


@query(sql(f"{LOCATED}, {POPULATION}", """SELECT n.county, n.year, n.offense_count, p.population,
round_even(n.offense_count / CAST(nullif(p.population, 0) AS DOUBLE) * 100000, 2) AS crime_rate_100k
FROM (SELECT county, year, count(*) AS offense_count FROM located WHERE county IS NOT NULL GROUP BY 1, 2) AS n
LEFT JOIN population AS p ON p.county = n.county AND p.year = n.year"""))
def crime_rate(spark, sf_dir):
    counts = summaries.county_year_counts(joins.attach_county(processed(spark, sf_dir), views.counties(spark)))
    return joins.crime_rate(counts, views.population(spark))


@query(sql(LOCATED, """SELECT c.county_name, c."GEOID", coalesce(n, 0) AS offense_count FROM counties AS c
LEFT JOIN (SELECT county, count(*) AS n FROM located GROUP BY 1) AS t ON t.county = c.county_name"""))
def counts_on_polygons(spark, sf_dir):
    return _county_units(spark, sf_dir).select("county_name", "GEOID", "offense_count")


def _county_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = summaries.county_year_counts(joins.attach_county(processed(spark, sf_dir), views.counties(spark)))
    return cut(joins.counts_on_polygons(views.counties(spark), counts))


# Spatial joins ---------------------------------------------------------------------------------------------------

_RADIUS = 0.01


@query(sql(LOCATED, 'SELECT incident_id, county, geoid AS "GEOID" FROM located'))
def point_in_polygon(spark, sf_dir):
    return joins.attach_county(processed(spark, sf_dir), views.counties(spark)).select("incident_id", "county", "GEOID")


_BORDER = 20_000
SHAPES = f"""{COUNTIES}, corners AS (SELECT *, (x0 + x1) / 2 AS xm, (y0 + y1) / 2 AS ym, x0 + (x1 - x0) / 8 AS ox, x1 - (x1 - x0) / 8 AS px,
y0 + (y1 - y0) / 8 AS oy, y1 - (y1 - y0) / 8 AS py, x0 + (x1 - x0) * 0.375e0 AS hx, x1 - (x1 - x0) * 0.375e0 AS kx,
y0 + (y1 - y0) * 0.375e0 AS hy, y1 - (y1 - y0) * 0.375e0 AS ky FROM counties),
rings AS (SELECT concat('L_', county_name) AS shape, 1e0 AS sign, [x0, x1, x1, xm, xm, x0] AS xs, [y0, y0, ym, ym, y1, y1] AS ys FROM corners
UNION ALL SELECT concat('ring_', county_name), 1e0, [ox, px, px, ox], [oy, oy, py, py] FROM corners
UNION ALL SELECT concat('ring_', county_name), -1e0, [hx, hx, kx, kx], [hy, ky, ky, hy] FROM corners
UNION ALL SELECT 'border', 1e0, list_concat([-106.7e0 + k * 6.6e-4 FOR k IN range({_BORDER})], [-93.5e0, -106.7e0]),
    list_concat([36e0 - (k % 2) * 0.05e0 FOR k IN range({_BORDER})], [28e0, 28e0])),
edges AS MATERIALIZED (SELECT shape, sign, x AS x1, y AS y1, lead(x, 1, first) OVER w AS x2, lead(y, 1, head) OVER w AS y2 FROM (
    SELECT shape, sign, unnest(xs) AS x, unnest(ys) AS y, unnest(range(len(xs))) AS k, xs[1] AS first, ys[1] AS head FROM rings) AS v
    WINDOW w AS (PARTITION BY shape, sign ORDER BY k)),
within_shape AS MATERIALIZED (SELECT p.incident_id, e.shape FROM clean AS p JOIN edges AS e
    ON greatest(e.y1, e.y2) >= p.latitude AND least(e.y1, e.y2) <= p.latitude AND greatest(e.x1, e.x2) >= p.longitude
    GROUP BY p.incident_id, e.shape
    HAVING sum(CASE WHEN (e.y1 > p.latitude) <> (e.y2 > p.latitude) AND ((e.y2 > e.y1) = ((e.x2 - e.x1) * (p.latitude - e.y1) > (e.y2 - e.y1) * (p.longitude - e.x1)))
        THEN 1 ELSE 0 END) % 2 = 1)"""


def shapes(spark: SparkSession) -> DataFrame:
    """An L and a square ring in each county, and one area-wide polygon of 20,002 vertices with a jagged border."""
    c = {n: F.col(n) for n in ("x0", "x1", "y0", "y1")}
    xm, ym = (c["x0"] + c["x1"]) / 2, (c["y0"] + c["y1"]) / 2
    width, height = c["x1"] - c["x0"], c["y1"] - c["y0"]

    def closed(*corners) -> Column:
        return F.array(*[G.vertex(x, y) for x, y in [*corners, corners[0]]])

    def square(share: float) -> tuple:
        return c["x0"] + width * share, c["y0"] + height * share, c["x1"] - width * share, c["y1"] - height * share

    (ox, oy, px, py), (hx, hy, kx, ky) = square(0.125), square(0.375)
    bent = F.array(F.array(closed((c["x0"], c["y0"]), (c["x1"], c["y0"]), (c["x1"], ym), (xm, ym), (xm, c["y1"]), (c["x0"], c["y1"]))))
    ring = F.array(F.array(closed((ox, oy), (px, oy), (px, py), (ox, py)), closed((hx, hy), (hx, ky), (kx, ky), (kx, hy))))
    both = F.inline(F.array(*[F.struct(F.concat(F.lit(kind), "county_name").alias("shape"), g.alias("geometry"))
                              for kind, g in (("L_", bent), ("ring_", ring))]))
    jagged = F.transform(F.sequence(F.lit(0), F.lit(_BORDER - 1)), lambda k: G.vertex(
        F.lit(-106.7) + k * F.lit(6.6e-4), F.lit(36.0) - (k % 2) * F.lit(0.05)))
    back = F.array(*[G.vertex(F.lit(x), F.lit(y)) for x, y in ((-93.5, 28.0), (-106.7, 28.0), (-106.7, 36.0))])
    border = spark.range(1).select(F.lit("border").alias("shape"), F.array(F.array(F.concat(jagged, back))).alias("geometry"))
    return views.counties(spark).select(both).unionByName(border)


@query(sql(f"{CLEAN}, {SHAPES}", "SELECT p.incident_id, w.shape FROM clean AS p LEFT JOIN within_shape AS w ON w.incident_id = p.incident_id"))
def polygon_join_shapes(spark, sf_dir):
    joined = joins.join_polygons(processed(spark, sf_dir), shapes(spark), {"shape": "shape"})
    return joined.select("incident_id", "shape")


@query(sql(f"{CLEAN}, {SHAPES}", """, parts AS (SELECT e.shape, sign, (e.x1 - f.ax) * (e.y2 - f.ay) - (e.x2 - f.ax) * (e.y1 - f.ay) AS c,
e.x1 + e.x2 - 2 * f.ax AS sx, e.y1 + e.y2 - 2 * f.ay AS sy, f.ax, f.ay
FROM edges AS e JOIN (SELECT shape, min(x1) AS ax, min(y1) AS ay FROM edges GROUP BY 1) AS f ON f.shape = e.shape),
ring_sums AS (SELECT shape, sign, ax, ay, sum(c) / 2 AS a, sum(sx * c) / 6 AS mx, sum(sy * c) / 6 AS my FROM parts GROUP BY ALL),
areas AS (SELECT shape, any_value(ax) AS ax, any_value(ay) AS ay, sum(sign * sign(a) * a) AS a, sum(sign * sign(a) * mx) AS mx, sum(sign * sign(a) * my) AS my
FROM ring_sums GROUP BY shape), hits AS (SELECT shape, count(*) AS n FROM within_shape GROUP BY 1)
SELECT areas.shape, round(a, 6) AS area, round(ax + mx / a, 6) AS centroid_lon, round(ay + my / a, 6) AS centroid_lat, coalesce(n, 0) AS incidents,
round(coalesce(n, 0) / a, 3) AS density FROM areas LEFT JOIN hits ON hits.shape = areas.shape"""))
def shape_density(spark, sf_dir):
    table = shapes(spark)
    counts = joins.join_polygons(processed(spark, sf_dir), table, {"shape": "shape"}).dropna(subset=["shape"]).groupBy("shape").agg(
        F.count(F.lit(1)).alias("incidents"))
    centre = G.centroid(F.col("geometry"))
    measured = table.select("shape", G.area(F.col("geometry")).alias("area"), centre["x"].alias("centroid_lon"), centre["y"].alias("centroid_lat"))
    joined = measured.join(counts, "shape", "left").fillna(0, ["incidents"]).withColumn("density", F.col("incidents") / F.col("area"))
    return rounded(rounded(joined, 6, "area", "centroid_lon", "centroid_lat"), 3, "density")


@query(sql(LOCATED, "SELECT incident_id, county AS place_name FROM located"))
def attach_place(spark, sf_dir):
    places = views.counties(spark).withColumnRenamed("county_name", "NAME")
    return joins.attach_city(processed(spark, sf_dir), places).select("incident_id", "place_name")


_NEAR = (f"FROM clean AS q JOIN clean AS d ON d.longitude BETWEEN q.longitude - {_RADIUS}1e0 AND q.longitude + {_RADIUS}1e0 AND "
         f"(d.longitude - q.longitude) * (d.longitude - q.longitude) + (d.latitude - q.latitude) * (d.latitude - q.latitude) "
         f"<= {_RADIUS}e0 * {_RADIUS}e0")


@query(sql(CLEAN, f"""SELECT q.incident_id AS query_id, d.incident_id AS data_id,
round(sqrt((d.longitude - q.longitude) * (d.longitude - q.longitude) + (d.latitude - q.latitude) * (d.latitude - q.latitude)), 9)
AS distance {_NEAR}"""))
def range_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return joins.range_join(p, p, _RADIUS).withColumn("distance", rounded_half_up(F.col("distance"), 9))


@query(sql(CLEAN, f"SELECT q.incident_id AS query_id, count(*) AS neighbours {_NEAR} GROUP BY 1"))
def count_within(spark, sf_dir):
    p = points(spark, sf_dir)
    return joins.count_within(p, p, _RADIUS)


@query(sql(CLEAN, """, n AS (SELECT q.incident_id AS query_id, unnest(min({'g': (d.longitude - q.longitude) * (d.longitude - q.longitude)
+ (d.latitude - q.latitude) * (d.latitude - q.latitude), 'id': d.incident_id}, 5)) AS v FROM clean AS q CROSS JOIN clean AS d GROUP BY 1)
SELECT query_id, v.id AS data_id, round(sqrt(v.g), 9) AS distance FROM n"""))
def knn_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(joins.nearest_neighbours(p, p, 5).drop("rank"), 9, "distance")


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT q.id AS query_id, d.id AS data_id, sqrt((d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y)) AS g, row_number() OVER (
PARTITION BY q.id ORDER BY (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y), d.id) AS nth FROM p AS q CROSS JOIN p AS d)
SELECT query_id, data_id, round(g, 9) AS distance, CAST(nth AS INTEGER) AS rank FROM r WHERE nth <= 3""")
def knn_embeddings(spark, sf_dir):
    p = views.points2d(spark, sf_dir)
    return rounded(joins.nearest_neighbours(p, p, 3), 9, "distance")


# Polygons and autocorrelation ------------------------------------------------------------------------------------


@query(sql(CELLS, f"""SELECT cell_id, round(((cx + 1) * {CELL}e0 - cx * {CELL}e0) * ((cy + 1) * {CELL}e0 - cy * {CELL}e0), 9) AS area,
round((cx + 0.5e0) * {CELL}e0, 6) AS centroid_x, round((cy + 0.5e0) * {CELL}e0, 6) AS centroid_y FROM cells"""))
def polygon_area_centroid(spark, sf_dir):
    middle = G.centroid(F.col("geometry"))
    return cells(spark, sf_dir).select("cell_id", F.round(G.area(F.col("geometry")), 9).alias("area"),
                                       F.round(middle["x"], 6).alias("centroid_x"), F.round(middle["y"], 6).alias("centroid_y"))


@query(sql(CELLS, "SELECT src, dst FROM queen"))
def queen_edges(spark, sf_dir):
    return contiguity.queen_neighbours(cells(spark, sf_dir), "cell_id")


@query(sql(CELLS, """SELECT a.cell_id AS src, b.cell_id AS dst FROM queen JOIN cells AS a ON a.cell_id = src
JOIN cells AS b ON b.cell_id = dst WHERE abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1"""))
def rook_edges(spark, sf_dir):
    return contiguity.rook_neighbours(cells(spark, sf_dir), "cell_id")


LAGGED = CELLS + """, lagged AS MATERIALIZED (SELECT c.cell_id, coalesce(sum(w * d.offense_count), 0e0) AS lag, count(d.cell_id) AS degree
FROM cells AS c LEFT JOIN queen ON src = c.cell_id LEFT JOIN cells AS d ON d.cell_id = dst GROUP BY 1)"""


@query(sql(LAGGED, "SELECT cell_id, round(lag, 6) AS spatial_lag FROM lagged"))
def spatial_lag(spark, sf_dir):
    units = cells(spark, sf_dir)
    lagged = contiguity.spatial_lag(units, contiguity.queen_neighbours(units, "cell_id"), "offense_count", "cell_id")
    return rounded(lagged.select("cell_id", "spatial_lag"), 6, "spatial_lag")


_G_STATS = "s AS (SELECT count(*) AS n, avg(offense_count) AS m, stddev_pop(offense_count) AS sd, sum(offense_count) AS t, sum(offense_count * offense_count) AS sq FROM cells)"


@query(sql(f"{LAGGED}, {_G_STATS}", """SELECT c.cell_id, round(((lag * degree + offense_count) / (degree + 1) - m)
/ (sd * sqrt((n / (degree + 1e0) - 1) / (n - 1e0))), 6) AS gi_z_score FROM cells AS c JOIN lagged AS l ON l.cell_id = c.cell_id, s"""))
def getis_ord_z(spark, sf_dir):
    units = cells(spark, sf_dir)
    z = autocorrelation.local_g(units, contiguity.queen_neighbours(units, "cell_id"), "offense_count", "cell_id")
    return rounded(z.select("cell_id", "gi_z_score"), 6, "gi_z_score")


@query(sql(f"{LAGGED}, {_G_STATS}", """, o AS (SELECT c.cell_id, lag, degree, n - 1 AS k, (t - offense_count) / (n - 1e0) AS mi,
(sq - offense_count * offense_count) / (n - 1e0) AS si FROM cells AS c JOIN lagged AS l ON l.cell_id = c.cell_id, s)
SELECT cell_id, round(CASE WHEN degree > 0 THEN (lag - mi) / sqrt((si - mi * mi) * (k / CAST(degree AS DOUBLE) - 1) / (k - 1e0)) END, 6)
AS gi_z_score FROM o"""))
def getis_ord_z_without_self(spark, sf_dir):
    units = cells(spark, sf_dir)
    z = autocorrelation.local_g(units, contiguity.queen_neighbours(units, "cell_id"), "offense_count", "cell_id", star=False)
    return rounded(z.select("cell_id", "gi_z_score"), 6, "gi_z_score")


def _mixed_sql(x: str) -> str:
    p = autocorrelation.PRIME
    square = f"({x}) * ({x}) % {p}"
    return f"({square} * ({square}) % {p} * ({x}) % {p})"


def _key_sql(slot: str) -> str:
    """The key of a slot's run, with the default seed."""
    p = autocorrelation.PRIME
    return _mixed_sql(f"({_mixed_sql(f'(CAST({pow(42, 5, p)} AS BIGINT) + {slot}) % {p}')} + run) % {p}")


def _permuted_sql(source: str, n: int, keep: str) -> str:
    """``source`` with ``place`` sent through the keyed permutation of 0 to n - 1, one subquery a round."""
    p, a = autocorrelation.PRIME, int(np.floor(np.sqrt(n - 1))) + 1
    b = -(-n // a)
    for again in range(a * b - n + 1):
        turns = ", ".join(f"{_mixed_sql(f'(key + {i + 1}) % {p}')} AS t{i}" for i in range(autocorrelation.ROUNDS))
        source = f"(SELECT *, place // {b} AS l, place % {b} AS r, {turns} FROM {source} AS s)"
        for i in range(autocorrelation.ROUNDS):
            moving, other, base = ("r", "l", b) if i % 2 else ("l", "r", a)
            mixed = _mixed_sql(f"({other} + t{i}) % {p}")
            source = f"(SELECT * REPLACE (({moving} + {mixed}) % {base} AS {moving}) FROM {source} AS s)"
        moved = f"CASE WHEN place >= {n} THEN l * {b} + r ELSE place END" if again else f"l * {b} + r"
        source = f"(SELECT {keep}, key, {moved} AS place FROM {source} AS s)"
    return source


_COUNTIES = views.COUNTY_COLS * views.COUNTY_ROWS
_TOP, _RUNS = autocorrelation.TIE, autocorrelation.PERMUTATIONS
UNITS = LOCATED + f""", units AS MATERIALIZED (SELECT c."GEOID", i, j, CAST(coalesce(n, 0) AS BIGINT) AS offense_count, CAST(coalesce(n, 0) AS DOUBLE) AS x,
row_number() OVER (ORDER BY c."GEOID") - 1 AS slot FROM counties AS c
LEFT JOIN (SELECT county, count(*) AS n FROM located GROUP BY 1) AS t ON t.county = c.county_name),
links AS MATERIALIZED (SELECT a.slot AS a, b.slot AS b, 1e0 / count(*) OVER (PARTITION BY a.slot) AS w FROM units AS a JOIN units AS b
ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND a.slot <> b.slot),
devs AS MATERIALIZED (SELECT *, x - avg(x) OVER () AS z, count(*) OVER () AS n, avg(x) OVER () AS m, stddev_pop(x) OVER () AS sd FROM units),
runs AS (SELECT range AS run FROM range(1, {_RUNS + 1}))"""
_PICKED = _permuted_sql(f"(SELECT slot, run, place, key FROM (SELECT slot, run, unnest(range(degree)) AS place, {_key_sql('slot')} AS key "
                        "FROM lagged, runs) AS k)", _COUNTIES - 1, "slot, run")


def _conditional_sql(value: str, sign: str) -> str:
    return f"""{UNITS}, lagged AS MATERIALIZED (SELECT d.*, {value} AS v, t.lag, t.degree, {sign} AS side FROM devs AS d
JOIN (SELECT a, avg({value}) AS lag, count(*) AS degree FROM links JOIN devs ON slot = b GROUP BY 1) AS t ON t.a = d.slot),
means AS (SELECT p.slot, run, avg(o.v) AS mean FROM {_PICKED} AS p
JOIN lagged AS o ON o.slot = p.place + CASE WHEN p.place >= p.slot THEN 1 ELSE 0 END GROUP BY 1, 2),
tested AS MATERIALIZED (SELECT m.slot, (least(hits, {_RUNS} - hits) + 1) / {_RUNS + 1}e0 AS p FROM (SELECT m.slot,
count(*) FILTER (mean * side >= lag * side - {_TOP} * (SELECT max(abs(v)) FROM lagged)) AS hits FROM means AS m JOIN lagged AS l ON l.slot = m.slot GROUP BY 1) AS m)"""


@query(sql(_conditional_sql("x", "1e0"), """SELECT "GEOID", offense_count, round(z, 6) AS gi_z_score, p AS gi_p_value, z > 1.645 AND p < 0.1 AS hotspot_90,
z > 1.96 AND p < 0.05 AS hotspot_95, z > 2.576 AND p < 0.01 AS hotspot_99, z < -1.96 AND p < 0.05 AS coldspot_95, p < 0.05 AS significant
FROM (SELECT "GEOID", offense_count, p, ((lag * degree + x) / (degree + 1) - m) / (sd * sqrt((n / (degree + 1e0) - 1) / (n - 1e0))) AS z
FROM lagged AS l JOIN tested AS t ON t.slot = l.slot) AS u"""))
def getis_ord_permutation(spark, sf_dir):
    scored = autocorrelation.getis_ord(_county_units(spark, sf_dir))
    return rounded(scored.select("GEOID", "offense_count", "gi_z_score", "gi_p_value", *autocorrelation.HOT_LEVELS,
                                 *autocorrelation.COLD_LEVELS, "significant"), 6, "gi_z_score")


_SPOTS = """SELECT cell_id, round(z, 6) AS gi_z_score, CASE WHEN z > 2.576 THEN 'Hot Spot 99%' WHEN z > 1.96
THEN 'Hot Spot 95%' WHEN z > 1.645 THEN 'Hot Spot 90%' WHEN z < -1.96 THEN 'Cold Spot 95%' ELSE 'Not Significant' END
AS spot_class FROM (SELECT c.cell_id, ((lag * degree + offense_count) / (degree + 1) - m)
/ (sd * sqrt((n / (degree + 1e0) - 1) / (n - 1e0))) AS z FROM cells AS c JOIN lagged AS l ON l.cell_id = c.cell_id, s) AS t"""


@query(sql(f"{LAGGED}, {_G_STATS}", _SPOTS))
def spot_classes(spark, sf_dir):
    """A z score beyond a bar implies a normal p below its level, so z alone decides in the SQL."""
    scored = autocorrelation.getis_ord(cells(spark, sf_dir), id="cell_id", p_method="normal")
    return rounded(autocorrelation.spot_class(scored).select("cell_id", "gi_z_score", "spot_class"), 6, "gi_z_score")


@query(sql(f"{LAGGED}, {_G_STATS}", """SELECT c.cell_id, round((n - 1) * (offense_count - m) * CASE WHEN degree > 0 THEN lag - m ELSE 0e0 END
/ (n * sd * sd), 6) AS lisa_I FROM cells AS c JOIN lagged AS l ON l.cell_id = c.cell_id, s"""))
def local_moran(spark, sf_dir):
    table = autocorrelation.local_moran(cells(spark, sf_dir), id="cell_id", p_method="normal")
    return rounded(table.select("cell_id", "lisa_I"), 6, "lisa_I")


@query(sql(_conditional_sql("z", "sign(z)"), """SELECT "GEOID", offense_count, round((n - 1) * z * lag / (n * sd * sd), 6) AS "lisa_I", round(lag, 6) AS lisa_lag,
p AS lisa_p, p < 0.05 AS lisa_sig, CASE WHEN p >= 0.05 THEN 'Not Significant' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z <= 0 AND lag > 0 THEN 'LH'
WHEN z <= 0 THEN 'LL' ELSE 'HL' END AS lisa_quadrant FROM lagged AS l JOIN tested AS t ON t.slot = l.slot"""))
def lisa_permutation(spark, sf_dir):
    table = autocorrelation.local_moran(_county_units(spark, sf_dir))
    return rounded(table.select("GEOID", "offense_count", "lisa_I", "lisa_lag", "lisa_p", "lisa_sig", "lisa_quadrant"),
                   6, "lisa_I", "lisa_lag")


_RELABELED = _permuted_sql(f"(SELECT slot, run, place, key FROM (SELECT slot, run, slot AS place, {_key_sql(str(_COUNTIES))} AS key "
                           "FROM devs, runs) AS k)", _COUNTIES, "slot, run")


@query(sql(UNITS, f""", mixed AS MATERIALIZED (SELECT p.slot, run, o.z FROM {_RELABELED} AS p JOIN devs AS o ON o.slot = p.place
UNION ALL SELECT slot, 0, z FROM devs), sums AS MATERIALIZED (SELECT a.run, sum(w * a.z * b.z) AS total FROM links AS l JOIN mixed AS a ON a.slot = l.a
JOIN mixed AS b ON b.slot = l.b AND b.run = a.run GROUP BY 1),
s AS (SELECT (SELECT total FROM sums WHERE run = 0) AS observed, (SELECT sum(z * z) FROM devs) AS zz),
h AS (SELECT count(*) AS hits FROM sums, s WHERE run > 0 AND total >= observed - {_TOP} * zz)
SELECT round({_COUNTIES} / (SELECT sum(w) FROM links) * observed / zz, 6) AS "I", (least(hits, {_RUNS} - hits) + 1) / {_RUNS + 1}e0 AS p_sim FROM s, h"""))
def global_moran_permutation(spark, sf_dir):
    return rounded(autocorrelation.global_moran_permutation_p(_county_units(spark, sf_dir)), 6, "I")


def _moran_sql(variables: dict[str, str], digits: int, tail: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{v}' AS v, cell_id, CAST({c} AS DOUBLE) AS x FROM cells" for v, c in variables.items())
    return sql(CELLS, f""", x AS MATERIALIZED ({long}), z AS MATERIALIZED (SELECT v, cell_id, x - avg(x) OVER (PARTITION BY v) AS z,
count(*) OVER (PARTITION BY v) AS n FROM x), g AS (SELECT sum(r) AS s0, sum(p) / 2 AS s1, sum((r + c) * (r + c)) AS s2 FROM
(SELECT src, sum(w) AS r, sum(w_back) AS c, sum((w + w_back) * (w + w_back)) AS p FROM queen GROUP BY 1) AS u),
c AS (SELECT a.v, sum(w * a.z * b.z) AS cross_sum FROM queen JOIN z AS a ON a.cell_id = src JOIN z AS b ON b.cell_id = dst AND b.v = a.v GROUP BY 1),
t AS (SELECT v, max(n) AS n, sum(z * z) AS zz FROM z GROUP BY 1),
m AS (SELECT t.v, n / s0 * cross_sum / zz AS i, -1e0 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1e0) * s0 * s0)
- 1e0 / ((n - 1e0) * (n - 1e0)) AS var FROM t JOIN c ON c.v = t.v, g) {tail}""")


@query(_moran_sql({"all": "offense_count"}, 6, """SELECT round(i, 6) AS "I", round(e, 6) AS expected, round(var, 9) AS variance,
round((i - e) / sqrt(var), 5) AS z_score, round(""" + normal_p_sql("((i - e) / sqrt(var))") + """, 9) AS p_value,
(i - e) / sqrt(var) > 1.959963984540054e0 AS is_clustered FROM m"""))
def global_moran(spark, sf_dir):
    m = autocorrelation.global_moran(cells(spark, sf_dir), id="cell_id")
    return rounded(rounded(rounded(m, 6, "I", "expected"), 9, "variance", "p_value"), 5, "z_score")


@query(_moran_sql({c: c for c in ("violent", "property", "other")}, 4, """SELECT v AS crime_type, round_even(i, 4) AS "morans_I",
round_even(""" + normal_p_sql("((i - e) / sqrt(var))") + """, 4) AS p_value, (i - e) / sqrt(var) > 1.959963984540054e0 AS clustered FROM m"""))
def moran_by_type(spark, sf_dir):
    return autocorrelation.moran_by_type(cells(spark, sf_dir), ["violent", "property", "other"], "cell_id")


# Density and Ripley ----------------------------------------------------------------------------------------------

_GRID = 300
KDE = CLEAN + f""", s AS MATERIALIZED (SELECT count(*) AS n, min(longitude) - (max(longitude) - min(longitude)) * 0.05e0 AS x0,
max(longitude) + (max(longitude) - min(longitude)) * 0.05e0 AS x1, min(latitude) - (max(latitude) - min(latitude)) * 0.05e0 AS y0,
max(latitude) + (max(latitude) - min(latitude)) * 0.05e0 AS y1, pow(count(*), -1e0 / 3) AS f2, var_samp(longitude) AS xx,
var_samp(latitude) AS yy, covar_samp(longitude, latitude) AS xy FROM clean),
h AS MATERIALIZED (SELECT *, f2 * f2 * (xx * yy - xy * xy) AS det FROM s),
axis_x AS (SELECT CAST(range AS INTEGER) AS gx, range * ((x1 - x0) / {_GRID - 1}e0) + x0 AS lon FROM range({_GRID}), s),
axis_y AS (SELECT CAST(range AS INTEGER) AS gy, range * ((y1 - y0) / {_GRID - 1}e0) + y0 AS lat FROM range({_GRID}), s),
sloped AS MATERIALIZED (SELECT gx, latitude, -0.5e0 * f2 * yy * (lon - longitude) * (lon - longitude) / det AS e0,
f2 * xy * (lon - longitude) / det AS e1 FROM axis_x, clean, h), curve AS (SELECT -0.5e0 * f2 * xx / det AS e2 FROM h),
sums AS MATERIALIZED (SELECT gx, gy, sum(exp(e0 + (lat - latitude) * (e1 + (lat - latitude) * e2))) AS total
FROM sloped, (SELECT gy, lat, e2 FROM axis_y, curve) AS y GROUP BY 1, 2),
surface AS MATERIALIZED (SELECT gx, gy, lon, lat, total / (n * 2 * pi() * sqrt(det)) AS density
FROM sums JOIN axis_x USING (gx) JOIN axis_y USING (gy), h)"""


@query(sql(KDE, "SELECT gx, gy, round(lon, 6) AS lon, round(lat, 6) AS lat, round(density, 7) AS density FROM surface"))
def kde_surface(spark, sf_dir):
    return rounded(rounded(density.kernel_density(processed(spark, sf_dir), grid_size=_GRID), 6, "lon", "lat"), 7, "density")


@query(sql(KDE, "SELECT gx, gy, density >= (SELECT quantile_cont(density, 0.9) FROM surface) AS is_hotspot FROM surface"))
def kde_hotspots(spark, sf_dir):
    surface = cut(density.kernel_density(processed(spark, sf_dir), grid_size=_GRID))
    return density.with_hotspots(surface).select("gx", "gy", "is_hotspot")


_R = [float(r) for r in ripley.DEFAULT_R]
_STEP = _R[1] - _R[0]
_AT_LEAST = "greatest(CAST(floor((g - 0.01e0) / " + repr(_STEP) + "e0) AS INTEGER) - 1, 0)"
# The bin of a distance is the number of radii below it: a guess from the even steps, then exact comparisons around it.
RIPLEY = CLEAN + f""", radii AS MATERIALIZED (SELECT [{", ".join(repr(r) + "e0" for r in _R)}] AS rs),
r AS (SELECT unnest(rs) AS r, unnest(range(len(rs))) AS nth FROM radii),
d AS MATERIALIZED (SELECT low + CAST(g > rs[low + 1] AS INTEGER) + CAST(coalesce(g > rs[low + 2], false) AS INTEGER) + CAST(coalesce(g > rs[low + 3], false) AS INTEGER) AS bin,
count(*) AS pairs FROM (SELECT g, {_AT_LEAST} AS low FROM (SELECT sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude)
+ (a.latitude - b.latitude) * (a.latitude - b.latitude)) AS g
FROM clean AS a JOIN clean AS b ON a.longitude BETWEEN b.longitude - 2.01e0 AND b.longitude + 2.01e0) AS t WHERE g > 0 AND g <= {_R[-1]!r}e0) AS p, radii GROUP BY 1),
k AS (SELECT r, coalesce((SELECT sum(pairs) FROM d WHERE bin <= nth), 0)
/ (n / area * n) AS k FROM r, (SELECT count(*) AS n, (max(longitude) - min(longitude)) * (max(latitude) - min(latitude)) AS area FROM clean) AS s)"""


@query(sql(RIPLEY, 'SELECT round(r, 9) AS r, round(k, 6) AS "K", round(sqrt(k / pi()), 6) AS "L", round(sqrt(k / pi()) - r, 6) AS "L_minus_r" FROM k'))
def ripleys_k(spark, sf_dir):
    curve = ripley.ripleys_k(processed(spark, sf_dir), _R)
    return rounded(rounded(curve, 9, "r"), 6, "K", "L", "L_minus_r")


@query(sql(RIPLEY, "SELECT round(arg_max(r, sqrt(k / pi()) - r), 9) AS r, round(max(sqrt(k / pi()) - r), 6) AS \"L_minus_r\" FROM k"))
def peak_scale(spark, sf_dir):
    curve = ripley.with_regions(ripley.ripleys_k(processed(spark, sf_dir), _R))
    return rounded(rounded(summaries.peak_scale(curve), 9, "r"), 6, "L_minus_r")


# Clusters --------------------------------------------------------------------------------------------------------

_EPS, _MIN_PTS = 0.02, 8
DBSCAN = CLEAN.replace("incidents AS", "RECURSIVE incidents AS", 1) + f""", pairs AS MATERIALIZED (SELECT a.incident_id AS a, b.incident_id AS b
FROM clean AS a JOIN clean AS b ON a.longitude BETWEEN b.longitude - 0.021e0 AND b.longitude + 0.021e0
AND (a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude) <= {_EPS}e0 * {_EPS}e0),
core AS MATERIALIZED (SELECT a AS id FROM pairs GROUP BY 1 HAVING count(*) >= {_MIN_PTS}),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
comp(id, label) USING KEY (id) AS (SELECT id, id FROM core UNION
SELECT l.b, min(c.label) FROM comp AS c JOIN links AS l ON l.a = c.id JOIN recurring.comp AS o ON o.id = l.b WHERE c.label < o.label GROUP BY 1),
numbered AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster_id FROM comp),
border AS (SELECT a AS id, min(cluster_id) AS cluster_id FROM pairs JOIN numbered ON numbered.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1),
labelled AS MATERIALIZED (SELECT p.incident_id, p.longitude, p.latitude, coalesce(n.cluster_id, e.cluster_id, -1) AS cluster_id, n.id IS NOT NULL AS is_core
FROM clean AS p LEFT JOIN numbered AS n ON n.id = p.incident_id LEFT JOIN border AS e ON e.id = p.incident_id)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.dbscan(processed(spark, sf_dir), _EPS, _MIN_PTS)


@query(sql(DBSCAN, "SELECT incident_id, cluster_id, is_core FROM labelled"))
def dbscan_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("incident_id", "cluster_id", "is_core")


@query(sql(DBSCAN, "SELECT max(cluster_id) + 1 AS n_clusters, count(*) FILTER (cluster_id = -1) AS n_noise FROM labelled"))
def dbscan_summary(spark, sf_dir):
    return dbscan.cluster_counts(_labelled(spark, sf_dir))


@query(sql(DBSCAN, """SELECT cluster_id, count(*) AS size, round(avg(longitude), 10) AS centroid_lon, round(avg(latitude), 10) AS centroid_lat,
round(sqrt(var_pop(longitude) + var_pop(latitude)), 6) AS spread_deg FROM labelled WHERE cluster_id >= 0 GROUP BY 1"""))
def cluster_stats(spark, sf_dir):
    table = dbscan.cluster_statistics(_labelled(spark, sf_dir))
    return rounded(rounded(table, 10, "centroid_lon", "centroid_lat"), 6, "spread_deg")


@query(sql(DBSCAN, """SELECT cluster_id, count(*) AS size, round(min(longitude), 9) AS west, round(max(longitude), 9) AS east,
round(min(latitude), 9) AS south, round(max(latitude), 9) AS north FROM labelled WHERE cluster_id >= 0 GROUP BY 1"""))
def cluster_hulls(spark, sf_dir):
    """Hulls by their extent, which SQL can state too."""
    table = hulls.cluster_hulls(_labelled(spark, sf_dir), _EPS)
    b = G.bounds(F.col("geometry"))
    return table.select("cluster_id", "size", F.round(b["min_x"], 9).alias("west"), F.round(b["max_x"], 9).alias("east"),
                        F.round(b["min_y"], 9).alias("south"), F.round(b["max_y"], 9).alias("north"))


@query()
def kmeans_centres(spark, sf_dir):
    return kmeans.run_kmeans(processed(spark, sf_dir), k=8, starts=20).centres


@query(sql(CLEAN, """SELECT CAST(8 AS INTEGER) AS k, count(*) AS points, CAST(8 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS nearer_to_another,
CAST(0 AS BIGINT) AS centres_off_their_mean, true AS inertia_is_theirs FROM clean"""))
def kmeans_invariants(spark, sf_dir):
    """What must hold of the result, which SQL can state: all points are with their nearest centre, all centres are means of
    their points (as far as a settled run may move), and the inertia is that of the points."""
    result = kmeans.run_kmeans(processed(spark, sf_dir), k=8, starts=20)
    x, y = F.col("longitude"), F.col("latitude")
    gaps = [(x - r.lon) * (x - r.lon) + (y - r.lat) * (y - r.lat) for r in result.centres.orderBy("cluster_id").collect()]
    points = cut(result.points.select("kmeans_cluster", "longitude", "latitude", F.least(*gaps).alias("least"),
                                      F.get(F.array(*gaps), F.col("kmeans_cluster")).alias("gap")))
    means = points.groupBy(F.col("kmeans_cluster").alias("cluster_id")).agg(F.avg("longitude").alias("mx"), F.avg("latitude").alias("my"))
    off = result.centres.join(means, "cluster_id").agg(
        F.count_if(F.hypot(F.col("mx") - F.col("lon"), F.col("my") - F.col("lat")) > kmeans.TOLERANCE)).scalar()
    inertia = result.summary.first().inertia
    return points.agg(
        F.lit(8).alias("k"), F.count(F.lit(1)).alias("points"), F.count_distinct("kmeans_cluster").alias("clusters"),
        F.count_if(F.col("least") < F.col("gap")).alias("nearer_to_another"), F.sum("gap").alias("total")).select(
        "k", "points", "clusters", "nearer_to_another", off.alias("centres_off_their_mean"),
        (F.abs(F.col("total") - inertia) <= F.col("total") * 1e-9).alias("inertia_is_theirs"))


@query()
def kmeans_elbow(spark, sf_dir):
    return kmeans.elbow(processed(spark, sf_dir), k_values=range(2, 15), starts=10)


@query("SELECT CAST(range AS INTEGER) AS k, true AS falls FROM range(2, 15)")
def kmeans_elbow_falls(spark, sf_dir):
    """The curve of 130 runs must fall with every further cluster."""
    curve = kmeans.elbow(processed(spark, sf_dir), k_values=range(2, 15), starts=10)
    before = F.lag("inertia").over(Window.orderBy("k"))
    return curve.select("k", F.coalesce(F.col("inertia") < before, F.col("inertia") > 0).alias("falls"))


# Models ----------------------------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> model.Features:
    features = model.feature_table(cells(spark, sf_dir), extra=["violent", "absent"], id="cell_id")
    return model.Features(cut(features.table), features.names)


@query(sql(LAGGED, f"""SELECT c.cell_id, round(((cx + 1) * {CELL}e0 - cx * {CELL}e0) * ((cy + 1) * {CELL}e0 - cy * {CELL}e0), 9) AS area_deg2,
round((cx + 0.5e0) * {CELL}e0, 6) AS centroid_lon, round((cy + 0.5e0) * {CELL}e0, 6) AS centroid_lat, round(lag, 6) AS spatial_lag,
CAST(violent AS DOUBLE) AS violent, CAST(offense_count AS DOUBLE) AS label FROM cells AS c JOIN lagged AS l ON l.cell_id = c.cell_id"""))
def feature_table(spark, sf_dir):
    return rounded(rounded(_features(spark, sf_dir).table, 9, "area_deg2"), 6, "centroid_lon", "centroid_lat", "spatial_lag")


@query()
def random_forest_metrics(spark, sf_dir):
    return model.train_random_forest(_features(spark, sf_dir), id="cell_id").metrics


@query()
def gradient_boosting_importances(spark, sf_dir):
    return model.train_gradient_boosting(_features(spark, sf_dir), id="cell_id").importances


@query()
def risk_grid(spark, sf_dir):
    units = cells(spark, sf_dir)
    trained = model.train_random_forest(_features(spark, sf_dir), id="cell_id")
    return layers.risk_layer(model.risk_grid(trained, units))


# Layers ----------------------------------------------------------------------------------------------------------


@query(sql(ENRICHED, """SELECT CAST(floor(longitude / 0.005e0) AS BIGINT) AS cx, CAST(floor(latitude / 0.005e0) AS BIGINT) AS cy,
round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude, CAST(sum(severity) AS DOUBLE) AS weight, count(*) AS incidents
FROM enriched GROUP BY 1, 2"""))
def layer_heat(spark, sf_dir):
    return rounded(layers.heat_layer(processed(spark, sf_dir)), 9, "latitude", "longitude")


_COLOURS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in layers.OFFENSE_COLOURS.items())


@query(sql(ENRICHED, f"""SELECT incident_id, longitude, latitude, offense_type, year, city,
CASE offense_type {_COLOURS} ELSE '{layers.DEFAULT_COLOUR}' END AS colour FROM enriched ORDER BY {sample_order_sql(42)} LIMIT {layers.MAX_MARKERS}"""))
def layer_incidents(spark, sf_dir):
    return layers.incident_layer(processed(spark, sf_dir))


@query(sql(DBSCAN, "SELECT count(*) FILTER (cluster_id >= 0) AS clustered, count(*) FILTER (cluster_id = -1) AS noise FROM labelled"))
def layer_clusters(spark, sf_dir):
    labelled = cut(_labelled(spark, sf_dir))
    layer = layers.cluster_layer(labelled, hulls.cluster_hulls(labelled, _EPS))
    noise = layer.noise.agg(F.count("colour").alias("n")).scalar()
    return layer.clustered.agg(F.count("colour").alias("clustered")).withColumn("noise", noise)


_SPOT_COLOURS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in layers.SPOT_COLOURS.items())


@query(sql(f"{LAGGED}, {_G_STATS}", f"SELECT *, CASE spot_class {_SPOT_COLOURS} END AS colour FROM ({_SPOTS}) AS spots"))
def layer_hotspots(spark, sf_dir):
    scored = autocorrelation.getis_ord(cells(spark, sf_dir), id="cell_id", p_method="normal")
    return rounded(layers.hotspot_layer(scored, "cell_id").drop("geometry"), 6, "gi_z_score")


@query(sql(ENRICHED, """SELECT layer, n FROM (SELECT 'incidents' AS layer, least(count(*), 2000) AS n FROM enriched UNION ALL
SELECT 'heat', count(*) FROM (SELECT DISTINCT floor(longitude / 0.005e0), floor(latitude / 0.005e0) FROM enriched) AS h
UNION ALL SELECT 'choropleth', 120 UNION ALL SELECT 'cities', 6) AS t"""))
def layer_composite(spark, sf_dir):
    table = layers.composite_layers(processed(spark, sf_dir), _county_units(spark, sf_dir))
    return table.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


_CITY_ROWS = " UNION ALL ".join(f"SELECT 'cities', '{c}', {lat}e0, {lon}e0, NULL, NULL" for c, (lat, lon) in layers.MAJOR_CITIES.items())


@query(sql(f"{DBSCAN}, {LOCATED.removeprefix(CLEAN + ', ')}, enriched AS (SELECT *, CAST(CASE offense_type {_SEVERITY} ELSE 3 END AS INTEGER) AS severity FROM clean)",
           f"""SELECT 'heat' AS layer, concat(CAST(floor(longitude / 0.005e0) AS BIGINT), '_', CAST(floor(latitude / 0.005e0) AS BIGINT)) AS name,
round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude, CAST(sum(severity) AS DOUBLE) AS value, NULL AS colour
FROM enriched GROUP BY floor(longitude / 0.005e0), floor(latitude / 0.005e0)
UNION ALL SELECT 'choropleth', c.county_name, NULL, NULL, CAST(coalesce(n, 0) AS DOUBLE), NULL FROM counties AS c
LEFT JOIN (SELECT county, count(*) AS n FROM located GROUP BY 1) AS t ON t.county = c.county_name
UNION ALL SELECT 'clusters', CAST(cluster_id AS VARCHAR), round(max(latitude), 9), round(max(longitude), 9), CAST(count(*) AS DOUBLE), NULL
FROM labelled WHERE cluster_id >= 0 GROUP BY cluster_id
UNION ALL SELECT * FROM (SELECT 'incidents', CAST(incident_id AS VARCHAR), round(latitude, 9), round(longitude, 9), NULL,
CASE offense_type {_COLOURS} ELSE '{layers.DEFAULT_COLOUR}' END FROM enriched ORDER BY {sample_order_sql(1)} LIMIT {layers.MAX_COMPOSITE_MARKERS}) AS s
UNION ALL {_CITY_ROWS}"""))
def layer_composite_rows(spark, sf_dir):
    """All rows of the composite map, hulls included (by their northern and eastern ends)."""
    incidents = processed(spark, sf_dir)
    drawn = hulls.cluster_hulls(_labelled(spark, sf_dir), _EPS)
    table = layers.composite_layers(incidents, _county_units(spark, sf_dir), drawn)
    b = G.bounds(F.col("geometry"))
    is_hull = F.col("layer") == "clusters"
    text = lambda c: F.col(c).cast("string")
    return table.select(
        "layer", F.coalesce(F.when(F.col("layer") == "heat", F.concat_ws("_", "cx", "cy")), "county_name", text("cluster_id"),
                            text("incident_id"), "city").alias("name"),
        F.round(F.coalesce("latitude", F.when(is_hull, b["max_y"])), 9).alias("latitude"),
        F.round(F.coalesce("longitude", F.when(is_hull, b["max_x"])), 9).alias("longitude"),
        F.coalesce("weight", F.col("offense_count").cast("double"), F.col("size").cast("double")).alias("value"), "colour")


@query()
def choropleth_features(spark, sf_dir):
    return layers.choropleth_features(cells(spark, sf_dir), "offense_count", "cell_id")


@query(sql(LOCATED, """, s AS (SELECT * FROM located WHERE year BETWEEN 2018 AND 2022 AND offense_type = 'burglary')
SELECT county, count(*) AS total, 'burglary' AS top_crime FROM s WHERE county IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def dashboard_counties(spark, sf_dir):
    located = joins.attach_county(processed(spark, sf_dir), views.counties(spark))
    return layers.dashboard(located, (2018, 2022), "burglary").top_counties


# Sources: the given tables written in each format below the shared folder and read back ---------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pointweave-sources/{name}-{uuid.uuid4().hex}"


@query("""SELECT concat('county ', CAST(o_custkey % 50 AS VARCHAR)) AS county, CAST(year(o_orderdate) AS DOUBLE) AS year, o_orderpriority AS offense_type,
CASE WHEN count(*) % 7 = 0 THEN 0e0 ELSE CAST(count(*) AS DOUBLE) END AS offense_count FROM orders GROUP BY o_custkey % 50, year(o_orderdate), o_orderpriority""")
def source_county_counts(spark, sf_dir):
    """Counts as CSV under other column names, with counts that are no numbers."""
    orders = views.table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.concat(F.lit("county "), (F.col("o_custkey") % 50).cast("string")).alias("CNTY_NM"),
                            F.year("o_orderdate").alias("Report_Year"), F.col("o_orderpriority").alias("crime_type")).agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "counts")
    counts.withColumn("incident_count", F.when(F.col("n") % 7 == 0, "n/a").otherwise(F.col("n").cast("string"))).drop("n").write.csv(path, header=True)
    return readers.read_county_counts(spark, path).select("county", "year", "offense_type", "offense_count")


@query(sql(INCIDENTS, """SELECT CAST(incident_id AS VARCHAR) AS incident_id, round(longitude, 9) AS lng, round(latitude, 9) AS y,
trim(offense_type) AS offense FROM incidents WHERE longitude IS NOT NULL AND incident_id % 13 <> 0"""))
def source_incidents(spark, sf_dir):
    """Located incidents as CSV under other coordinate names, some of them no numbers, and found again by alias."""
    path = _folder(spark, "incidents")
    latitude = F.when(F.col("incident_id") % 13 == 0, "unknown").otherwise(F.col("latitude").cast("string"))
    views.incidents(spark, sf_dir).select("incident_id", F.col("longitude").alias("lng"), latitude.alias("y"),
                                          F.trim("offense_type").alias("offense")).write.csv(path, header=True)
    return rounded(readers.read_incidents(spark, path), 9, "lng", "y")


@query(sql(CLEAN, "SELECT * FROM clean WHERE year BETWEEN 2019 AND 2021 AND longitude BETWEEN -98e0 AND -95.3e0 AND latitude BETWEEN 29.5e0 AND 32e0"))
def source_processed(spark, sf_dir):
    """The processed table written by year and place; a read of a box in some years skips the other files and row groups."""
    folder = _folder(spark, "processed")
    writers.write_processed(clean.clean_incidents(views.incidents(spark, sf_dir)), folder, partition_by=["year"], space=("longitude", "latitude"))
    box = "year BETWEEN 2019 AND 2021 AND longitude BETWEEN -98 AND -95.3e0 AND latitude BETWEEN 29.5e0 AND 32"
    return readers.read_processed(spark, folder).filter(box).withColumn("year", F.col("year").cast("bigint"))


@query(sql(CELLS, f"""SELECT cell_id, CAST(offense_count AS VARCHAR) AS offense_count, round(cx * {CELL}e0, 9) AS west, round((cx + 1) * {CELL}e0, 9) AS east,
round(cy * {CELL}e0, 9) AS south, round((cy + 1) * {CELL}e0, 9) AS north,
round(((cx + 1) * {CELL}e0 - cx * {CELL}e0) * ((cy + 1) * {CELL}e0 - cy * {CELL}e0), 9) AS area FROM cells"""))
def source_polygons(spark, sf_dir):
    """Polygons as GeoJSON, one feature a line, so that large files split."""
    path = _folder(spark, "polygons")
    writers.write_features(cells(spark, sf_dir), path, ["cell_id", "offense_count"])
    table = readers.read_polygons(spark, path, ("cell_id", "offense_count"), "geojsonl")
    b = G.bounds(F.col("geometry"))
    return table.select("cell_id", "offense_count", *[F.round(c, 9).alias(n) for n, c in (
        ("west", b["min_x"]), ("east", b["max_x"]), ("south", b["min_y"]), ("north", b["max_y"]), ("area", G.area(F.col("geometry"))))])
