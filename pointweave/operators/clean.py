"""Cleaning and row-wise enrichment of incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, in_study_box, normalise_text, require_columns

# Severity per normalised offense; anything else scores DEFAULT_SEVERITY.
SEVERITY = {
    "murder": 10, "rape": 9, "robbery": 8, "aggravated assault": 7, "burglary": 6, "motor vehicle theft": 5,
    "drug offense": 5, "simple assault": 4, "larceny-theft": 3, "vandalism": 2, "arson": 7, "human trafficking": 9,
    "kidnapping/abduction": 8, "fraud": 4, "embezzlement": 3,
}
DEFAULT_SEVERITY = 3
VIOLENT = ("murder", "rape", "robbery", "aggravated assault", "simple assault", "kidnapping/abduction",
           "human trafficking")
PROPERTY = ("burglary", "larceny-theft", "motor vehicle theft", "arson", "vandalism", "fraud", "embezzlement")


def lookup(key: Column, table: dict[str, object]) -> Column:
    """Value of a small literal map, NULL when absent."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def drop_missing_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return df.filter(df[lon].isNotNull() & df[lat].isNotNull() & ~F.isnan(df[lon]) & ~F.isnan(df[lat]))


def filter_study_box(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Keep rows inside the study area, edges included; a plain range filter that Parquet scans can use."""
    return df.filter(in_study_box(F.col(lon), F.col(lat)))


def deduplicate(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``order`` value, or any row when there is no order column.

    Runs as a map-side combined aggregate, so a key that holds a large share of the rows shrinks before the shuffle.
    Unused columns are still pruned because each one is its own aggregate. ``order`` must be unique within a key.
    """
    if order is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = [F.min_by(c, order).alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.min(order).alias(order), *picked).select(*df.columns)


def filter_years(df: DataFrame, year_min: int, year_max: int, year: str = "year") -> DataFrame:
    """Numeric years in the closed range; text that is no number is dropped."""
    return df.withColumn(year, as_double(F.col(year)).cast("bigint")
                         if dict(df.dtypes)[year] == "string" else F.col(year)
                         ).filter(F.col(year).between(year_min, year_max))


def clean_incidents(
    df: DataFrame,
    lon: str = "longitude",
    lat: str = "latitude",
    year_min: int = 2010,
    year_max: int = 2024,
    order: str | None = "incident_id",
) -> DataFrame:
    """Missing points, study box, duplicates, offense text, years: each step skipped when its columns are absent.

    Duplicates are judged on the raw offense text, before it is normalised. The year filter depends on a duplicate
    key only, so Catalyst pushes it below the aggregate and into the scan.
    """
    if lon in df.columns and lat in df.columns:
        df = df.transform(drop_missing_points, lon, lat).transform(filter_study_box, lon, lat)
    keys = [c for c in (lon, lat, "offense_type", "year") if c in df.columns]
    if keys:
        df = deduplicate(df, keys, order if order in df.columns else None)
    if "offense_type" in df.columns:
        df = df.withColumn("offense_type", normalise_text(F.col("offense_type")))
    if "year" in df.columns:
        df = filter_years(df, year_min, year_max)
    return df


def filter_offense(df: DataFrame, pattern: str, column: str = "offense_type") -> DataFrame:
    """Rows whose offense contains the pattern, ignoring case."""
    return df.filter(F.col(column).rlike("(?i)" + pattern))


def filter_selection(df: DataFrame, years: tuple[int, int] | None = None, offense: str | None = None) -> DataFrame:
    """Interactive selection: closed year range and one offense, ``None`` or ``"All"`` for every offense."""
    if years is not None and "year" in df.columns:
        df = df.filter(F.col("year").between(*years))
    if offense and offense != "All" and "offense_type" in df.columns:
        df = df.filter(F.col("offense_type") == offense)
    return df


def add_severity(df: DataFrame) -> DataFrame:
    require_columns(df, ["offense_type"])
    score = F.coalesce(lookup(F.col("offense_type"), SEVERITY), F.lit(DEFAULT_SEVERITY))
    return df.withColumn("severity", score.cast("int"))


def add_category(df: DataFrame) -> DataFrame:
    """``violent``, ``property`` or ``other``; unchanged when there is no offense column."""
    if "offense_type" not in df.columns:
        return df
    offense = F.col("offense_type")
    return df.withColumn("crime_category", F.when(offense.isin(*VIOLENT), "violent").when(
        offense.isin(*PROPERTY), "property").otherwise("other"))


def add_temporal_features(df: DataFrame, date: str | None = None) -> DataFrame:
    """Month, weekday (Monday 0), hour and season; a date that cannot be read gives NULL in all four."""
    if not date or date not in df.columns:
        return df
    ts = F.col(date) if dict(df.dtypes)[date].startswith("timestamp") else F.try_to_timestamp(F.col(date).cast("string"))
    month = F.month(ts)
    season = (F.when(month.isin(12, 1, 2), "Winter").when(month.between(3, 5), "Spring")
              .when(month.between(6, 8), "Summer").when(month.isNotNull(), "Fall"))
    return df.withColumns({"month": month, "day_of_week": F.weekday(ts), "hour": F.hour(ts), "season": season})
