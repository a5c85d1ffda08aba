"""Yearly series: changes, rolling means and trend tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import correlation_p, normal_p
from .summaries import pearson


def yearly_series(df: DataFrame, year: str = "year", count: str | None = "offense_count") -> DataFrame:
    """Sum of counts (or number of rows) per year; the result has one row per year and is small."""
    value = F.count(F.lit(1)) if count is None else F.sum(count)
    return df.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(value.alias("count"))


def percent_change(value: str, order: str) -> Column:
    before = F.lag(value).over(Window.orderBy(order))
    return (F.try_divide(F.col(value).cast("double"), before.cast("double")) - 1) * 100


def centred_mean(value: str, order: str, window: int) -> Column:
    """Rolling mean over a centred frame of ``window`` rows; NULL where the frame is cut off."""
    after = (window - 1) // 2
    frame = Window.orderBy(order).rowsBetween(-(window - 1 - after), after)
    return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))


def temporal_trend(df: DataFrame, year: str = "year", count: str | None = "offense_count", window: int = 3) -> DataFrame:
    """``year, count, pct_change, rolling_avg`` in year order. The windows run on the yearly table only."""
    return yearly_series(df, year, count).select(
        "year", "count", percent_change("count", "year").alias("pct_change"),
        centred_mean("count", "year", window).alias("rolling_avg")).orderBy("year")


def _series(df: DataFrame, year: str, count: str | None) -> DataFrame:
    """The yearly table as one row holding the values in year order."""
    rows = F.array_sort(F.collect_list(F.struct("year", F.col("count").cast("double").alias("count"))))
    return yearly_series(df, year, count).agg(rows.alias("rows")).select(
        F.transform("rows", lambda r: r["count"]).alias("values"))


def mann_kendall(df: DataFrame, year: str = "year", count: str | None = "offense_count", alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall test on the yearly series: ``statistic, variance, z, p_value, trend_direction``."""

    def later_signs(x: Column, i: Column) -> Column:
        return F.aggregate("values", F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s")), lambda acc, y: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["s"] + F.when(acc["i"] > i, F.signum(y - x)).otherwise(0.0)).alias("s")), lambda acc: acc["s"])

    signs = F.transform("values", later_signs)
    n = F.size("values").cast("double")
    ties = F.transform(F.array_distinct("values"), lambda v: F.size(F.filter("values", lambda w: w == v)))
    tied = F.aggregate(ties, F.lit(0.0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5))
    table = _series(df, year, count).select(
        F.aggregate(signs, F.lit(0.0), lambda acc, s: acc + s).alias("statistic"),
        ((n * (n - 1) * (2 * n + 5) - tied) / 18).alias("variance"))
    s, v = F.col("statistic"), F.col("variance")
    scored = table.withColumn("z", F.when((s == 0) | (v <= 0), F.lit(0.0)).otherwise((s - F.signum(s)) / F.sqrt(v)))
    tested = scored.withColumn("p_value", normal_p("z"))
    return tested.withColumn("trend_direction", _direction(F.col("z"), F.col("p_value"), alpha))


def _direction(slope: Column, p: Column, alpha: float) -> Column:
    return F.when((slope > 0) & (p < alpha), "increasing").when(
        (slope < 0) & (p < alpha), "decreasing").otherwise("no trend")


def linear_trend(df: DataFrame, year: str = "year", count: str | None = "offense_count", alpha: float = 0.05) -> DataFrame:
    """Least-squares slope of the yearly series against its position: ``statistic, p_value, trend_direction``.

    Fewer than two years or a constant series give slope 0, no p-value and no trend.
    """
    indexed = yearly_series(df, year, count).select(
        (F.row_number().over(Window.orderBy("year")) - 1).cast("double").alias("x"),
        F.col("count").cast("double").alias("y"))
    fit = indexed.agg(F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"),
                      pearson(F.col("x"), F.col("y")).alias("r"),
                      F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop("y").alias("spread"))
    flat = (F.col("n") < 2) | (F.col("spread") == 0)
    fit = fit.select(F.when(flat, F.lit(0.0)).otherwise(F.col("slope")).alias("statistic"),
                     F.when(~flat, F.col("r")).alias("r"), "n")
    return fit.withColumn("p_value", correlation_p("r", "n")).select(
        "statistic", "p_value", _direction(F.col("statistic"), F.col("p_value"), alpha).alias("trend_direction"))
