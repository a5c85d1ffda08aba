"""Scalar column expressions and plan-time column lookup."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Study-area bounding box (inclusive), degrees.
STUDY_BOX = {"min_lon": -106.65, "max_lon": -93.51, "min_lat": 25.84, "max_lat": 36.50}
EARTH_RADIUS_KM = 6371.0

# Accepted spellings per canonical column, first match wins.
LON_ALIASES = ("longitude", "lon", "x", "lng", "long")
LAT_ALIASES = ("latitude", "lat", "y")
CANONICAL_ALIASES = {
    "offense_type": ("offense_type", "offense", "crime_type", "offense_desc", "nibrs_offense_name", "ucr_offense"),
    "year": ("year", "report_year", "incident_year", "data_year"),
    "county": ("county", "county_name", "cnty_nm"),
    "city": ("city", "city_name", "place_name", "agency_city"),
    "offense_count": ("offense_count", "count", "num_offenses", "incident_count", "value"),
}


def quoted(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(columns: Sequence[str], aliases: Iterable[str]) -> str | None:
    """First alias present among ``columns``, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[a.lower()] for a in aliases if a.lower() in by_lower), None)


def find_lon_lat(columns: Sequence[str], lon: str | None = None, lat: str | None = None) -> tuple[str, str]:
    lon = lon or find_column(columns, LON_ALIASES)
    lat = lat or find_column(columns, LAT_ALIASES)
    if lon is None or lat is None:
        raise ValueError(f"no longitude/latitude columns among {list(columns)}; name them explicitly")
    return lon, lat


def rename_canonical(df: DataFrame) -> DataFrame:
    """Rename the first alias found of each canonical column."""
    found = {find_column(df.columns, a): name for name, a in CANONICAL_ALIASES.items()}
    return df.withColumnsRenamed({src: dst for src, dst in found.items() if src and src != dst})


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"DataFrame is missing required columns: {missing}")


def as_double(c: Column) -> Column:
    """Number or NULL; never raises under ANSI mode."""
    return c.try_cast("double")


def in_study_box(lon: Column, lat: Column) -> Column:
    b = STUDY_BOX
    return lon.between(b["min_lon"], b["max_lon"]) & lat.between(b["min_lat"], b["max_lat"])


def normalise_text(c: Column) -> Column:
    """Lower case, outer white space stripped, inner runs of white space made one space; NULL stays NULL."""
    stripped = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.regexp_replace(stripped, r"\s+", " ")


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(squared_distance(x1, y1, x2, y2))


def _haversine_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, form: str = "asin") -> Column:
    """Great-circle distance; ``form`` picks the arc-sine or the two-argument arc-tangent identity."""
    chord = F.least(_haversine_chord(lon1, lat1, lon2, lat2), F.lit(1.0))
    if form == "asin":
        return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))
    if form == "atan2":
        return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))
    raise ValueError(f"unknown form {form!r}")


def linspace(index: Column, lo: Column, hi: Column, steps: int) -> Column:
    """Value ``index`` (0-based) of ``steps`` evenly spaced values; the last one is exactly ``hi``."""
    if steps == 1:
        return lo
    return F.when(index == steps - 1, hi).otherwise(index * ((hi - lo) / F.lit(float(steps - 1))) + lo)


def rounded_half_up(c: Column, digits: int) -> Column:
    """What ``round`` returns for a DOUBLE, to the last bit, without its decimal arithmetic for almost all values.

    Below 2**40 units of the last digit, binary and decimal value of a double are within 2**-12 units of each other and of the
    product, so unless that is close to a tie both round to one whole number, and its division by a power of ten is exact to
    half a bit. Other values, NULL and NaN too, take the slow way.
    """
    if not 0 <= digits <= 15:
        return F.round(c, digits)
    scale = F.lit(float(10**digits))
    units = c * scale
    plain = (c >= 0) & (units < float(2**40)) & (F.abs(units - F.floor(units) - 0.5) > 1e-3)
    return F.when(plain, F.floor(units + 0.5) / scale).otherwise(F.round(c, digits))


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Global aggregates as a scalar subquery: a struct usable in any expression, without a join."""
    fields = [c.alias(name) for name, c in aggregates.items()]
    return df.agg(*fields).select(F.struct(*aggregates).alias("stats")).scalar()


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
