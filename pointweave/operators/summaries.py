"""Group summaries, rankings, samples and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_double, one_row, require_columns
from ..functions.special import correlation_p
from ..session import cut
from .ranks import accumulated, cumulative_counts, grouped_percentiles, percentiles


def county_year_counts(df: DataFrame, county: str = "county", year: str = "year",
                       count: str = "offense_count") -> DataFrame:
    """Incidents per county and year; rows without either key are left out."""
    require_columns(df, [county])
    return df.dropna(subset=[county, year]).groupBy(county, year).agg(F.count(F.lit(1)).alias(count))


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum as ``statistic, value`` rows."""
    v = df.select(as_double(F.col(column)).alias("v")).dropna()
    basic = v.agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                  F.min("v").alias("min"), F.max("v").alias("max"))
    rows = basic.unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = percentiles(v, "v", [0.25, 0.5, 0.75]).select(
        F.concat(F.format_number(F.col("probability") * 100, 0), F.lit("%")).alias("statistic"),
        F.col("percentile").alias("value"))
    return rows.unionByName(quartiles)


def summary_by_offense(df: DataFrame, count: str = "offense_count", offense: str = "offense_type") -> DataFrame:
    """Areas, total, mean, median, deviation, minimum and maximum per offense, rounded to cents, largest total first.

    Without an offense column the plain description of the count column is returned.
    """
    if offense not in df.columns:
        return describe_column(df, count)
    rows = df.filter(F.col(offense).isNotNull())
    basic = rows.groupBy(offense).agg(
        F.count(count).alias("n_areas"), F.sum(count).alias("total"), F.avg(count).alias("mean"),
        F.stddev_samp(count).alias("std"), F.min(count).alias("min"), F.max(count).alias("max"))
    medians = grouped_percentiles(rows, [offense], count, [0.5]).select(
        offense, F.col("percentile").alias("median"))
    whole = isinstance(df.schema[count].dataType, T.IntegralType)
    rounded = {c: F.bround(c, 2) for c in ("mean", "median", "std") + (() if whole else ("total", "min", "max"))}
    joined = basic.join(medians, offense, "left").withColumns(rounded)
    return joined.select(F.col(offense).alias("offense_type"), "n_areas", "total", "mean", "median", "std", "min",
                         "max").orderBy(F.desc("total"), "offense_type")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return frequencies(df, column).orderBy(F.desc("count"), column).limit(n)


def offense_shares(df: DataFrame, n: int = 8, offense: str = "offense_type") -> DataFrame:
    """The most frequent offenses in title case with their share among those shown."""
    top = top_values(df, offense, n)
    total = top.agg(F.sum("count").alias("n")).scalar()
    return top.select(F.initcap(offense).alias(offense), "count", (F.col("count") / total).alias("share"))


def distinct_choices(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)


def top_counties(df: DataFrame, n: int = 10, county: str = "county", offense: str = "offense_type") -> DataFrame:
    """Counties with most incidents and the most frequent offense of each."""
    per_offense = df.filter(F.col(county).isNotNull()).groupBy(county, offense).agg(F.count(offense).alias("rows"))
    first = F.min(F.when(F.col(offense).isNotNull(), F.struct((-F.col("rows")).alias("r"), F.col(offense).alias("o"))))
    return (per_offense.groupBy(county).agg(F.sum("rows").alias("total"), first["o"].alias("top_crime"))
            .orderBy(F.desc("total"), county).limit(n))


def kpi_row(df: DataFrame, years: tuple[int, int] | None = None, city: str = "city",
            offense: str = "offense_type") -> DataFrame:
    """Incident count, most frequent city and offense, and the year span; empty when nothing is selected."""
    span = [F.lit(y) for y in years] if years else [F.min("year"), F.max("year")]

    def most_frequent(column: str) -> Column:
        return F.mode(column, True) if column in df.columns else F.lit("N/A")

    return df.agg(
        F.count(F.lit(1)).alias("incidents"), most_frequent(city).alias("top_city"),
        F.initcap(most_frequent(offense)).alias("top_crime"),
        span[0].cast("bigint").alias("year_from"), span[1].cast("bigint").alias("year_to"),
    ).filter(F.col("incidents") > 0)


def bounding_box(df: DataFrame, lon: str = "longitude", lat: str = "latitude", pad: float = 0.0) -> DataFrame:
    """One row of bounds, widened on each side by a share ``pad`` of the extent."""
    b = df.agg(F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"),
               F.max(lat).alias("max_lat"))
    dx, dy = (F.col("max_lon") - F.col("min_lon")) * pad, (F.col("max_lat") - F.col("min_lat")) * pad
    return b.select((F.col("min_lon") - dx).alias("min_lon"), (F.col("max_lon") + dx).alias("max_lon"),
                    (F.col("min_lat") - dy).alias("min_lat"), (F.col("max_lat") + dy).alias("max_lat"))


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Each column scaled to [0, 1] over the table; a constant column scales to 0."""
    stats = one_row(df, **{f"lo_{i}": F.min(c) for i, c in enumerate(columns)},
                    **{f"hi_{i}": F.max(c) for i, c in enumerate(columns)})

    def scaled(i: int, c: str) -> Column:
        lo, hi = stats[f"lo_{i}"], stats[f"hi_{i}"]
        return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))

    return {c: scaled(i, c) for i, c in enumerate(columns)}


def risk_score(df: DataFrame, indicators: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max scaled indicators on a 0-100 scale.

    Indicators that are missing or not numeric count as 0, and their weight still counts in the divisor.
    """
    total = sum(indicators.values())
    if total == 0:
        raise ValueError("sum of indicator weights must be > 0")
    present = [c for c in indicators if c in df.columns]
    if not present:
        return df.withColumn("risk_score", F.lit(0.0))
    temporary = {f"__indicator_{i}": F.coalesce(as_double(F.col(c)), F.lit(0.0)) for i, c in enumerate(present)}
    prepared = df.withColumns(temporary)
    scaled = min_max_scaled(prepared, list(temporary))
    parts = [scaled[t] * F.lit(indicators[c] / total) for t, c in zip(temporary, present)]
    score = F.bround(sum(parts[1:], parts[0]) * 100, 2)
    return prepared.withColumn("risk_score", score).drop(*temporary)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL when either is constant there.

    The built-in ``corr`` raises on constant input under ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered column pair in long form, over rows where both are present."""
    columns = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"), F.col(f"c{i}").alias("correlation"))
               for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return row.select(F.inline(F.array(*entries)))


def _present(name: str) -> Column:
    """Numbers, NULL for what is none."""
    return F.nullif(as_double(F.col(name)), F.lit(float("nan")))


def bivariate_correlation(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Pearson and Spearman correlation with two-sided p-values of a target with each predictor.

    All predictors are worked on together, in one wide table. Ranks of their distinct values are looked up for each row, and
    then only sums for each distinct value of the target are kept, whose ranks close the sums. So the rows are shuffled once
    by the target, and once more for each predictor that has too many distinct values to broadcast.
    """
    names = [p for p in predictors if p in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, pearson_r double, pearson_p double, "
                                                   "spearman_r double, spearman_p double, n bigint")
    at = range(len(names))
    # A row without target, or without any predictor, is in no sum.
    wide = df.select(_present(target).alias("a"), *[_present(p).alias(f"b{i}") for i, p in enumerate(names)]).dropna(subset=["a"])
    linear = wide.agg(*[pearson(F.col("a"), F.col(f"b{i}")).alias(f"p{i}") for i in at], *[F.count(f"b{i}").alias(f"n{i}") for i in at])
    linear = linear.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"p{i}").alias("pearson"), F.col(f"n{i}").alias("n")) for i in at])))
    centred = F.col("below") + (F.col("rows") + 1) / 2 - (F.col("total") + 1) / 2
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"b{i}").alias("value")) for i in at])).alias("e")
    of_b = cut(cumulative_counts(wide.select(entries).select("e.*"), ["at"], "value").select("at", "value", "rows", centred.alias("rank")))
    ranked = wide
    for i in at:
        own = of_b.filter(F.col("at") == i).select(F.col("value").alias(f"b{i}"), F.col("rank").alias(f"y{i}"))
        ranked = ranked.join(own, f"b{i}", "left")
    sums = cut(ranked.groupBy("a").agg(*[F.sum(f"y{i}").alias(f"y{i}") for i in at], *[F.count(f"y{i}").alias(f"n{i}") for i in at]))
    of_a = accumulated(sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("a").alias("value"), F.col(f"n{i}").alias("rows"),
                                                                F.col(f"y{i}").alias("y")) for i in at])).alias("e")).select("e.*").filter("rows > 0"),
                       ["at"], "value", ["y"])
    x = F.col("x")
    across = of_a.withColumn("x", centred).groupBy("at").agg(F.sum(x * F.col("y")).alias("xy"), F.sum(F.col("rows") * x * x).alias("xx"))
    along = of_b.groupBy("at").agg(F.sum(F.col("rows") * F.col("rank") * F.col("rank")).alias("yy"))
    spearman = across.join(along, "at").select("at", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("spearman"))
    predictor = F.element_at(F.array(*[F.lit(p) for p in names]), F.col("at") + 1)
    n = F.col("n").cast("double")
    return linear.join(spearman, "at").withColumn("predictor", predictor).filter(F.col("n") >= 3).select(
        F.lit(target).alias("var1"), F.col("predictor").alias("var2"), F.bround("pearson", 4).alias("pearson_r"),
        F.bround(correlation_p(F.col("pearson"), n), 4).alias("pearson_p"),
        F.bround("spearman", 4).alias("spearman_r"),
        F.bround(correlation_p(F.col("spearman"), n), 4).alias("spearman_p"), "n",
    ).orderBy(F.desc("pearson_r"), "var2")


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when fewer), the first in the order of MD5 over seed and key: the same under any partitioning,
    and in any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def peak_scale(curve: DataFrame, at: str = "r", value: str = "L_minus_r") -> DataFrame:
    """Scale where a curve is highest, and its height."""
    return curve.agg(F.max_by(at, value).alias(at), F.max(value).alias(value))
