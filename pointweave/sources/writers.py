"""Writers: processed tables and GeoJSON features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import point_geojson, to_geojson
from ..operators.blocks import with_curve_position


def write_processed(df: DataFrame, folder: str, name: str = "incidents", partition_by: Sequence[str] = (),
                    space: tuple[str, str] | None = None, files: int | None = None, **options: object) -> str:
    """Overwrite one Parquet table; ``partition_by`` lets later reads prune, e.g. by year.

    ``space`` names the coordinates whose Z-order the rows are written in, within each partition: a row group then covers a
    small area, and a filter by a box skips all groups whose bounds lie outside of it. ``files`` is the number of ranges
    the table is cut into, as many as the session has shuffle partitions if not given.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if space is not None:
        position = "__curve"
        order = [*partition_by, position]
        count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = with_curve_position(df, *space, position).repartitionByRange(count, *order).sortWithinPartitions(*order).drop(position)
    df.write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(path)
    return path


def features(df: DataFrame, properties: Sequence[str], geometry: str | None = "geometry",
             lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One GeoJSON feature per row in a text column ``value``; points when ``geometry`` is None."""
    shape: Column = to_geojson(F.col(geometry)) if geometry else point_geojson(F.col(lon), F.col(lat))
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        shape.alias("geometry"),
        F.struct(*properties).alias("properties"),
    )).alias("value"))


def write_features(df: DataFrame, path: str, properties: Sequence[str], geometry: str | None = "geometry") -> str:
    """Newline-delimited features, written in parallel."""
    features(df, properties, geometry).write.mode("overwrite").text(path)
    return path
