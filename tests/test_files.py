import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks


def test_wide_csv_and_six_digits(spark, tmp_path):
    (tmp_path / "in.csv").write_text("date,11,22,99\n2001-01-01,1.5,NaN,7\n2001-01-02,123456.789,2,7\n")
    long = files.wide_daily(spark, str(tmp_path / "in.csv"), {"11": "mouth", "22": "above"})
    got = {(r.segment, str(r.date)): r.flow for r in long.collect()}
    assert got == {("mouth", "2001-01-01"): 1.5, ("above", "2001-01-01"): None, ("mouth", "2001-01-02"): 123456.789, ("above", "2001-01-02"): 2.0}
    sinks.write_csv(long.where("segment = 'mouth'").orderBy("date"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert "123457" in text and "2001-01-02" in text


def test_features_and_assets(spark, tmp_path):
    line = {"type": "Feature", "properties": {"osm_way": 5}, "geometry": {"type": "LineString", "coordinates": [[79.4, 28.1], [79.5, 28.2]]}}
    (tmp_path / "way.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    got = files.features(spark, str(tmp_path / "way.geojson")).orderBy("seq").collect()
    assert [(r.way, r.seq, r.lon) for r in got] == [(5, 0, 79.4), (5, 1, 79.5)]
    df = spark.sql("select map('B04', 'red', 'visual_SCL', 'mask') as a")
    row = df.select(files.first_asset(F.col("a"), ["scl"]).alias("x"), files.first_asset(F.col("a"), ["b04", "scl"]).alias("y")).first()
    assert (row.x, row.y) == ("mask", "red")


def test_fallback_checks_and_years(spark, tmp_path):
    good = spark.createDataFrame([(2001,)], "year int")
    assert files.first_working([lambda: 1 / 0, lambda: good.limit(0), lambda: good]).count() == 1
    with pytest.raises(RuntimeError):
        files.first_working([lambda: good.limit(0)])
    days = spark.sql("select 'a' as k, explode(array(date'2001-01-01', date'2001-01-03')) as date, 1.0D as flow")
    with pytest.raises(Exception, match="missing or negative"):
        files.checked_gap_free(days, "k").collect()
    wanted = spark.createDataFrame([(2001,), (2002,)], "year int")
    assert [r.year for r in files.new_years(good, wanted).collect()] == [2002]
    path = str(tmp_path / "years")
    sinks.upsert_years(spark.createDataFrame([(2001, 1), (2002, 2)], "year int, v int"), path)
    sinks.upsert_years(spark.createDataFrame([(2002, 5)], "year int, v int"), path)
    assert {(r.year, r.v) for r in spark.read.parquet(path).collect()} == {(2001, 1), (2002, 5)}


def test_report(spark):
    text = sinks.report("Flow", {"mean": 3.5, "Years": spark.createDataFrame([(2001, None)], "year int, v double")})
    assert "- mean: 3.5" in text and "| 2001 | n/a |" in text


def test_a_cut_table_says_so(spark):
    made = sinks.report("t", {"rows": spark.range(5)}, most=3)
    assert made.count("| ") == 4 and "Only the first 3 rows" in made
    assert "Only" not in sinks.report("t", {"rows": spark.range(3)}, most=3)


def test_features(spark, tmp_path):
    rows = spark.createDataFrame([(1, 79.5, 28.25, "a")], "id int, lon double, lat double, name string")
    sinks.write_features(rows, str(tmp_path / "f"), "lon", "lat")
    got = json.loads(spark.read.text(str(tmp_path / "f")).first()[0])
    assert got == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [79.5, 28.25]}, "properties": {"id": 1, "name": "a"}}
