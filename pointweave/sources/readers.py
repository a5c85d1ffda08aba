"""Readers: count tables, incident files, crime-API JSON, polygon files and processed tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import as_double, find_lon_lat, quoted, rename_canonical
from ..functions.geometry import GEOMETRY

# Fixed value: state code kept by ``read_counties(..., study_state_only=True)``.
STUDY_STATE = "48"


def read_csv(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Header CSV with every column as text; failures name the path."""
    try:
        return spark.read.options(header=True, mode="PERMISSIVE", **options).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"there is nothing at {path}") from error
        raise RuntimeError(f"Spark could not open {path}: {error}") from error


def read_county_counts(spark: SparkSession, path: str) -> DataFrame:
    """County counts under canonical names; years that are no numbers become NULL, such counts become 0."""
    df = rename_canonical(read_csv(spark, path))
    if "year" in df.columns:
        df = df.withColumn("year", as_double(F.col("year")))
    if "offense_count" in df.columns:
        df = df.withColumn("offense_count", F.coalesce(as_double(F.col("offense_count")), F.lit(0.0)))
    return df


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replace struct columns by their leaves, named by dotted path."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                column = quoted(here[0])
                for name in here[1:]:
                    column = column.getField(name)
                yield column.alias(".".join(here))

    return df.select(*leaves(df.schema))


def read_crime_json(spark: SparkSession, path: str) -> DataFrame:
    """API responses: an object with a ``data`` list, or a bare list of records; nested records are flattened.

    Pass a folder or a glob of response files; each file is one response and is read by one task.
    """
    raw = spark.read.json(path, multiLine=True)
    types = dict(raw.dtypes)
    if "data" in types and types["data"].startswith("array"):
        others = [c for c in raw.columns if c != "data"]
        wrapped, bare = raw.filter(F.col("data").isNotNull()), raw.filter(F.col("data").isNull())
        # Fields that stand beside a ``data`` list belong to the response, unless records of bare lists have them too.
        beside = wrapped.agg(*[F.count(c).alias(c) for c in others]).first().asDict() if others else {}
        fields = [c for c in others if not beside[c]]
        records = wrapped.select(F.explode("data").alias("record")).select("record.*") if types["data"].startswith(
            "array<struct") else None
        if fields:
            bare = bare.dropna("all", subset=fields)
            held = bare.agg(*[F.count(c).alias(c) for c in others]).first().asDict()
            own = flatten_structs(bare.select(*[quoted(c) for c in others if held[c] or not beside[c]]))
            records = own if records is None else flatten_structs(records).unionByName(own, allowMissingColumns=True)
        if records is None:
            return spark.createDataFrame([], T.StructType([]))
        raw = records
    elif not raw.columns:
        return raw
    return rename_canonical(flatten_structs(raw))


def read_incidents(spark: SparkSession, path: str, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """Located incidents; coordinate columns found by alias unless named; rows without numeric coordinates dropped."""
    df = read_csv(spark, path)
    lon, lat = find_lon_lat(df.columns, lon, lat)
    return df.withColumns({lon: as_double(quoted(lon)), lat: as_double(quoted(lat))}).dropna(subset=[lon, lat])


# Coordinates stay text at first, because polygons and multipolygons nest differently.
_FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"


def _coordinates_to_geometry(kind, text):
    """Coordinates text of a Polygon or MultiPolygon as the nested-array geometry."""

    def ring(r):
        return F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))

    as_polygon = F.from_json(text, "array<array<array<double>>>")
    as_multi = F.from_json(text, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(F.transform(as_polygon, ring))).when(
        kind == "MultiPolygon", F.transform(as_multi, lambda p: F.transform(p, ring))).cast(GEOMETRY)


#: Every feature of a collection has this value, and strings can only hold it escaped.
_MARK = '"Feature"'


def _features_of_collections(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections, cut at feature borders by Spark's text reader, so that one file is many tasks.

    A file is read as records between the texts ``"Feature"``: what comes before the first is the head of the collection,
    and each later record is the rest of a feature, which ends where its braces do. That needs ``type`` to be the first
    member of a feature, as it is in all common writers; other files fail with the advice to read them whole.
    """
    records = spark.read.option("lineSep", _MARK).text(path).select(F.ltrim(F.regexp_replace("value", r"^[\s\uFEFF]+", "")).alias("rest"))
    advice = F.raise_error(F.lit("a feature does not begin with its type; read it with file_format='geojson-whole'"))
    is_rest = F.when(F.col("rest").startswith("}"), advice.cast("boolean")).otherwise(F.col("rest").startswith(","))
    schema = f"{_FEATURE}, broken string"
    options = {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
    parsed = records.filter(is_rest).select(F.from_json(F.concat(F.lit('{"type":' + _MARK), "rest"), schema, options).alias("feature"))
    whole = F.when(F.col("feature.broken").isNotNull(), advice.cast("string")).otherwise(F.col("feature.type"))
    return parsed.select(whole.alias("type"), "feature.properties", "feature.geometry")


def read_polygons(spark: SparkSession, path: str, properties: tuple[str, ...] = ("STATEFP", "NAME", "GEOID"),
                  file_format: str = "geojson") -> DataFrame:
    """Polygons with the named properties and a ``geometry`` column.

    ``geojson`` reads feature collections and ``geojsonl`` one feature per line, and both split large files;
    ``geojson-whole`` reads collections of any form, one file in one task; ``parquet`` reads tables that already hold the
    nested-array geometry.
    """
    if file_format == "parquet":
        return spark.read.parquet(path)
    if file_format == "geojsonl":
        features = spark.read.schema(_FEATURE).json(path)
    elif file_format == "geojson":
        features = _features_of_collections(spark, path)
    elif file_format == "geojson-whole":
        features = (spark.read.schema(f"features array<struct<{_FEATURE}>>").json(path, multiLine=True)
                    .select(F.explode("features").alias("feature")).select("feature.*"))
    else:
        raise ValueError(f"unknown polygon format {file_format!r}")
    names = [F.try_element_at("properties", F.lit(p)).alias(p) for p in properties]
    return features.select(*names, _coordinates_to_geometry(
        F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry"))


def read_counties(spark: SparkSession, path: str, study_state_only: bool = True, file_format: str = "geojson") -> DataFrame:
    """County polygons with an upper-case ``county_name``."""
    df = read_polygons(spark, path, file_format=file_format)
    if study_state_only:
        df = df.filter(F.col("STATEFP") == STUDY_STATE)
    return df.withColumn("county_name", F.upper("NAME"))


def read_places(spark: SparkSession, path: str, file_format: str = "geojson") -> DataFrame:
    return read_polygons(spark, path, file_format=file_format)


def read_processed(spark: SparkSession, folder: str, name: str = "incidents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
