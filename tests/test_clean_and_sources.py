import json

import pytest
from pyspark.sql import Row, functions as F

from pointweave.functions import columns as C
from pointweave.operators import clean, summaries
from pointweave.sources import readers, synthetic, writers

SCHEMA = "incident_id bigint, longitude double, latitude double, offense_type string, year string, city string"


@pytest.fixture(scope="module")
def generated(spark):
    return synthetic.synthetic_incidents(spark, 500, seed=0).persist()


def test_synthetic_shape(generated):
    assert generated.count() == 500
    assert set(generated.columns) == {"longitude", "latitude", "offense_type", "severity", "year", "city", "incident_id"}
    row = generated.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min("longitude").alias("x0"),
                        F.max("longitude").alias("x1"), F.min("latitude").alias("a0"), F.max("latitude").alias("a1"),
                        F.countDistinct("incident_id").alias("ids"), F.min("severity").alias("s0")).first()
    assert 2018 <= row.y0 and row.y1 <= 2022 and row.ids == 500 and row.s0 >= 2
    assert -110 <= row.x0 and row.x1 <= -90 and 24 <= row.a0 and row.a1 <= 37


def test_synthetic_weights(spark):
    counts = {r.offense_type: r["count"] for r in synthetic.synthetic_incidents(spark, 20000).groupBy("offense_type").count().collect()}
    assert abs(counts["Larceny-Theft"] / 20000 - 0.30) < 0.02 and abs(counts["Murder"] / 20000 - 0.01) < 0.005


def test_cleaning_steps(spark):
    rows = [
        (1, -99.5, 30.0, "  Murder  ", "2018", "a"), (0, -99.5, 30.0, "  Murder  ", "2018", "b"),
        (2, -99.5, 30.0, "murder", "2018", "c"), (3, 0.0, 50.0, "murder", "2018", "d"),
        (4, -98.0, 29.0, "Simple \t Assault", "2099", "e"), (5, None, 29.0, "x", "2018", "f"),
        (6, float("nan"), 29.0, "x", "2018", "g"), (7, -98.0, 29.0, "Simple \t  Assault", "2020", "h"),
        (8, -106.65, 36.50, None, "2020", "i"), (9, -98.0, 29.0, "x", "no year", "j")]
    out = {r.incident_id: r for r in clean.clean_incidents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {0, 2, 7, 8}
    assert out[0].city == "b" and out[0].offense_type == "murder" and out[7].offense_type == "simple assault"
    assert out[8].offense_type is None and out[7].year == 2020


def test_cleaning_skips_absent_columns(spark):
    assert clean.clean_incidents(spark.createDataFrame([Row(a=1)])).count() == 1


def test_deduplicate_is_independent_of_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("incident_id"), (F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    a = clean.deduplicate(df.repartition(5), ["k"], "incident_id").collect()
    assert sorted((r.k, r.v) for r in a) == [(k, k) for k in range(7)]


def test_severity_and_category(spark):
    df = spark.createDataFrame([("murder",), ("fraud",), ("loitering",), (None,)], "offense_type string")
    out = clean.add_category(clean.add_severity(df)).collect()
    assert [(r.severity, r.crime_category) for r in out] == [(10, "violent"), (4, "property"), (3, "other"), (3, "other")]
    with pytest.raises(ValueError):
        clean.add_severity(df.withColumnRenamed("offense_type", "o"))


def test_temporal_features(spark):
    df = spark.createDataFrame([("2024-01-01 13:00:00",), ("2023-09-10",), ("not a date",)], "d string")
    out = [tuple(r)[1:] for r in clean.add_temporal_features(df, "d").collect()]
    assert out == [(1, 0, 13, "Winter"), (9, 6, 0, "Fall"), (None, None, None, None)]
    assert clean.add_temporal_features(df).columns == ["d"]


def test_box_and_haversine(spark):
    df = spark.createDataFrame([(-99.5, 30.0), (0.0, 50.0), (-98.0, 29.0)], "longitude double, latitude double")
    assert clean.filter_study_box(df).count() == 2
    pair = [F.lit(v) for v in (-95.37, 29.76, -96.80, 32.78)]
    a, b = spark.range(1).select(C.haversine_km(*pair), C.haversine_km(*pair, form="atan2")).first()
    assert 350 < a < 430 and abs(a - b) < 1e-9


def test_cleaning_works_on_a_stream(spark, generated, tmp_path):
    source = str(tmp_path / "in")
    generated.write.parquet(source)
    stream = spark.readStream.schema(generated.schema).parquet(source)
    enriched = clean.add_category(clean.add_severity(clean.filter_study_box(stream)))
    run = enriched.writeStream.format("memory").queryName("enriched_stream").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("enriched_stream").count() == clean.filter_study_box(generated).count()


def test_county_counts_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CNTY_NM,Report_Year,crime_type,num_offenses\nA,2018,x,5\nB,bad,y,?\n")
    out = readers.read_county_counts(spark, str(tmp_path / "c.csv")).orderBy("county").collect()
    assert [(r.county, r.year, r.offense_type, r.offense_count) for r in out] == [("A", 2018.0, "x", 5.0), ("B", None, "y", 0.0)]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))


def test_crime_json(spark, tmp_path):
    records = [{"offense": "x", "data_year": 2020, "agency": {"name": "n", "place": {"code": 7}}}]
    (tmp_path / "a.json").write_text(json.dumps({"data": records, "pagination": {"page": 1}}))
    (tmp_path / "b.json").write_text(json.dumps(records))
    (tmp_path / "c.json").write_text(json.dumps({"data": []}))
    for name in ("a", "b"):
        out = readers.read_crime_json(spark, str(tmp_path / f"{name}.json"))
        row = out.first().asDict()
        assert row == {"offense_type": "x", "year": 2020, "agency.name": "n", "agency.place.code": 7}
    assert readers.read_crime_json(spark, str(tmp_path / "c.json")).count() == 0
    (tmp_path / "b.json").write_text(json.dumps(records * 2))
    mixed = readers.read_crime_json(spark, str(tmp_path)).collect()
    assert [r.asDict() for r in mixed] == [{"offense_type": "x", "year": 2020, "agency.name": "n", "agency.place.code": 7}] * 3


def test_incident_csv(spark, tmp_path):
    (tmp_path / "i.csv").write_text("id,LNG,lat\n1,-97.5,30.1\n2,west,30.1\n3,-97.5,\n")
    assert [r.id for r in readers.read_incidents(spark, str(tmp_path / "i.csv")).collect()] == ["1"]
    (tmp_path / "j.csv").write_text("id,east,north\n1,2,3\n")
    with pytest.raises(ValueError):
        readers.read_incidents(spark, str(tmp_path / "j.csv"))
    assert readers.read_incidents(spark, str(tmp_path / "j.csv"), "east", "north").count() == 1


def test_polygons_round_trip(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    parts = [{"type": "Feature", "properties": {"STATEFP": s, "NAME": n, "GEOID": g}, "geometry": geometry} for s, n, g, geometry in (
        ("48", "Abc", "48001", {"type": "Polygon", "coordinates": square}),
        ("48", "Def", "48003", {"type": "MultiPolygon", "coordinates": [square, [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}),
        ("01", "Out", "01001", {"type": "Polygon", "coordinates": square}))]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": parts}, indent=1))
    counties = readers.read_counties(spark, str(tmp_path / "p.geojson"))
    assert [r.county_name for r in counties.orderBy("GEOID").collect()] == ["ABC", "DEF"]
    assert readers.read_places(spark, str(tmp_path / "p.geojson")).count() == 3
    out = writers.write_features(counties, str(tmp_path / "out"), ["STATEFP", "NAME", "GEOID"])
    again = readers.read_polygons(spark, out, file_format="geojsonl").orderBy("GEOID").collect()
    assert [r.geometry for r in again] == [r.geometry for r in counties.orderBy("GEOID").collect()]


def test_processed_round_trip(spark, generated, tmp_path):
    writers.write_processed(generated, str(tmp_path), "t", ["year"])
    back = readers.read_processed(spark, str(tmp_path), "t").select(generated.columns)
    assert back.exceptAll(generated.withColumn("year", F.col("year").cast("int"))).count() == 0 and back.count() == 500


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        C.require_columns(spark.range(1), ["id", "missing"])


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 5.0), (10.0, 5.0)], "a double, b double")
    s = summaries.min_max_scaled(df, ["a", "b"])
    assert sorted(tuple(r) for r in df.select(s["a"], s["b"]).collect()) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_fixed_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = {r.id for r in summaries.fixed_sample(df.repartition(7), 100, "id").collect()}
    assert len(a) == 100 and a == {r.id for r in summaries.fixed_sample(df, 100, "id").collect()}
    assert summaries.fixed_sample(df, 5000, "id").count() == 1000


def test_bare_records_keep_fields_named_like_the_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"kind": "x", "n": 1}], "city": "envelope", "status": "ok"}')
    (tmp_path / "b.json").write_text('[{"kind": "y", "n": 2, "city": "Oslo"}]')
    table = readers.read_crime_json(spark, str(tmp_path))
    assert sorted((r.kind, r.city) for r in table.collect()) == [("x", None), ("y", "Oslo")] and "status" not in table.columns


def test_box_filters_skip_row_groups(spark, tmp_path):
    """A table written in Z-order: a small box touches few row groups of its years, and finds all of its rows."""
    import pyarrow.parquet as pq

    df = spark.range(200_000).select(
        F.col("id").alias("incident_id"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 10_000).alias("longitude"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_003)) / 10_000).alias("latitude"), (2020 + F.col("id") % 2).alias("year"))
    path = writers.write_processed(df, str(tmp_path), partition_by=["year"], space=("longitude", "latitude"), files=16,
                                   **{"parquet.block.size": 8192, "parquet.page.size": 2048})
    box = {"longitude": (3.0, 3.4), "latitude": (6.0, 6.3)}
    groups = []
    for file in tmp_path.rglob("*.parquet"):
        if file.is_file():
            meta = pq.ParquetFile(file).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                stats = {c: meta.row_group(g).column(at[c]).statistics for c in box}
                groups.append(all(stats[c].min <= high and stats[c].max >= low for c, (low, high) in box.items()))
    assert len(groups) >= 100 and sum(groups) < 0.05 * len(groups)
    inside = " AND ".join(f"{c} BETWEEN {low} AND {high}" for c, (low, high) in box.items())
    back = readers.read_processed(spark, str(tmp_path))
    assert path.endswith("incidents.parquet") and back.count() == 200_000
    assert {r.incident_id for r in back.filter(inside).collect()} == {r.incident_id for r in df.filter(inside).collect()}


def test_one_collection_is_many_tasks(spark, tmp_path):
    import json

    features = [{"type": "Feature", "properties": {"NAME": f'n "Feature" \u00e9 {i}', "GEOID": str(i)},
                 "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1.5], [i, 0]]]}} for i in range(3000)]
    features[7]["geometry"] = None
    path = tmp_path / "big.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": features, "bbox": [0, 0, 1, 1]}, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        table = readers.read_polygons(spark, str(path), ("NAME", "GEOID"))
        assert table.rdd.getNumPartitions() > 4
        whole = readers.read_polygons(spark, str(path), ("NAME", "GEOID"), "geojson-whole")
        assert sorted(map(str, table.collect())) == sorted(map(str, whole.collect())) and table.count() == 3000
        lines = tmp_path / "lines"
        writers.write_features(table.filter("geometry is not null"), str(lines), ["NAME", "GEOID"])
        again = readers.read_polygons(spark, str(lines), ("NAME", "GEOID"), "geojsonl")
        assert sorted(map(str, again.collect())) == sorted(map(str, table.filter("geometry is not null").collect()))
        odd = tmp_path / "odd.geojson"
        odd.write_text(json.dumps({"features": [{"geometry": None, "properties": {}, "type": "Feature"}] * 2}))
        with pytest.raises(Exception, match="geojson-whole"):
            readers.read_polygons(spark, str(odd)).collect()
        assert readers.read_polygons(spark, str(odd), file_format="geojson-whole").count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
