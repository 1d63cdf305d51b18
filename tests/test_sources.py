import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from firegrid.operators.cleaning import drop_null_rows
from firegrid.plans import training
from firegrid.operators.polygons import edges_from_rings
from firegrid.operators.weather import Features
from firegrid.sources import files as s

HEAD = "longitude,latitude,ppt,tmax,vbdmax\n"


def test_daily_files(spark, tmp_path):
    year = tmp_path / "2013"
    year.mkdir()
    (year / "20130105.csv").write_text(HEAD + "-120.0,35.0,0.5,20.0,1.0\n-121.0,36.0,-9999,21.0,1.5\n")
    (year / "20130106.csv").write_text(HEAD + "-120.0,35.0,0.0,22.0,2.0\n")
    (year / "notes.csv").write_text(HEAD + "0,0,0,0,0\n")
    (year / "20130107.txt").write_text(HEAD + "0,0,0,0,0\n")
    rows = s.read_weather_days(spark, str(tmp_path), [2013]).collect()
    assert sorted((r.date, r.tmax) for r in rows) == [
        (dt.date(2013, 1, 5), 20.0), (dt.date(2013, 1, 5), 21.0), (dt.date(2013, 1, 6), 22.0)]
    (tmp_path / "2014").mkdir()
    with pytest.raises(FileNotFoundError):
        s.read_weather_days(spark, str(tmp_path), [2014])
    with pytest.raises(FileNotFoundError, match="2014"):
        s.read_weather_days(spark, str(tmp_path), [2013, 2014])
    one = s.read_weather_days(spark, str(tmp_path), [2013], dates=("2013-01-06", "2013-01-31")).collect()
    assert [r.tmax for r in one] == [22.0]
    (tmp_path / "2015").mkdir()
    (tmp_path / "2015" / "20150101.csv").write_text("latitude,longitude,ppt,tmax,vbdmax\n35.0,-120.0,0.5,20.0,1.0\n")
    with pytest.raises(Exception, match="header"):
        s.read_weather_days(spark, str(tmp_path), [2015]).collect()


def test_fire_csv(spark, tmp_path):
    row = "34.5,-118.2,301.2,0.5,0.4,2013-01-05,1012,N,VIIRS,n,2,290.1,5.5,D,0\n"
    (tmp_path / "f.csv").write_text(
        "latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,"
        "bright_t31,frp,daynight,type\n" + row + row.replace("5.5", ""))
    df = s.read_fires(spark, str(tmp_path / "f.csv"))
    assert df.count() == 2 and drop_null_rows(df).count() == 1 and df.first().acq_date == dt.date(2013, 1, 5)
    s.write_csv(df.select("latitude", "frp"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def feature(state, kind, coords):
    return {"type": "Feature", "properties": {"STATEFP": state, "N": 1}, "geometry": {"type": kind, "coordinates": coords}}


def test_boundary(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 1.5], [1, 1]]
    docs = {"type": "FeatureCollection", "features": [
        feature("06", "MultiPolygon", [[ring, hole], [ring]]), feature("41", "Polygon", [ring])]}
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps(docs, indent=1))
    edges = s.read_boundary(spark, str(path), {"STATEFP": "06"})
    assert edges.count() == 9 and edges.select("polygon", "ring").distinct().count() == 3
    assert s.read_boundary(spark, str(path)).count() == 12
    first = edges.where("polygon = 0 AND ring = 0").orderBy("x1", "y1").first()
    assert (first.x1, first.y1, first.x2, first.y2) == (0.0, 0.0, 4.0, 0.0)


def daily(spark, days=20):
    return spark.range(days * 4).select(
        F.date_add(F.lit("2013-01-25").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
        (35.0 + F.col("id") % 4).alias("latitude"), (-120.0 + F.col("id") % 4).alias("longitude"),
        (10.0 + F.col("id") % 7).alias("tmax"), (F.col("id") % 3).cast("double").alias("ppt"),
        (F.col("id") % 5).cast("double").alias("vbdmax"))


def test_master_is_partitioned_and_pruned(spark, tmp_path):
    path = str(tmp_path / "master")
    s.write_weather_master(daily(spark), path)
    assert spark.read.parquet(path).count() == 80
    scan = s.scan_weather(spark, path, 2013, 2, (34.0, 36.0, -121.0, -118.0), ("2013-02-01", "2013-02-05"), ["latitude", "tmax", "date"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(latitude,34.0)" in plan
    assert "ppt" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert scan.count() == 10
    # a second write replaces only the months it holds
    s.write_weather_master(daily(spark).where("date >= '2013-02-01'").limit(8), path)
    months = {r.month: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert months == {1: 28, 2: 8}


def test_small_helpers(spark, tmp_path):
    a, b = spark.createDataFrame([(2013,), (2014,), (2014,)], "year int"), spark.createDataFrame([(2013,)], "year int")
    assert [r.year for r in s.pending_years(a, b).collect()] == [2014]
    assert [r.year for r in s.head_sample(a, 2, ["year"]).collect()] == [2013, 2014]
    s.write_json_row(b, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().year == 2013


def test_flows(spark, tmp_path):
    feats = training.build_weather(daily(spark), str(tmp_path / "m"), str(tmp_path / "f"), Features())
    assert feats.count() == 80 and "fire_risk_index" in feats.columns
    square = edges_from_rings(spark, [[(-121.0, 34.0), (-116.0, 34.0), (-116.0, 39.0), (-121.0, 39.0)]])
    raw = spark.range(60).select(
        (33.0 + F.col("id") % 6 + 0.05).alias("latitude"), (-120.05 + F.col("id") % 4).alias("longitude"),
        (300.0 + F.col("id")).alias("brightness"), (F.col("id") + 1.0).alias("frp"), F.lit("n").alias("confidence"),
        F.lit(0).alias("type"), F.date_add(F.lit("2013-01-25").cast("date"), (F.col("id") % 20).cast("int")).alias("acq_date"))
    clean = training.clean_fires(raw, square)
    assert clean.count() == 50
    table = training.label_fires(clean, square, n_negatives=40, total=70, size_km=25)
    assert {r.fire: r["count"] for r in table.groupBy("fire").count().collect()} == {1: 50, 0: 20}
    keyed = table.where("fire = 1").withColumn("fire_key", F.monotonically_increasing_id())
    matched = training.match(keyed, feats.select("latitude", "longitude", "date", "tmax", "fire_risk_index"))
    assert matched.count() == 50 and matched.where("weather_tmax IS NULL").count() == 0


def test_second_run_writes_only_new_years(spark, tmp_path):
    path = str(tmp_path / "years")
    rows = [(35.0 + k % 3, -120.0, dt.date(2012 + k % 4, 1 + k % 12, 1 + k % 28), float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, date date, tmax double")
    hole = spark.createDataFrame([(35.0, -120.0, None, 1.0)], df.schema)
    assert s.write_new_years(df.where("year(date) < 2014").unionByName(hole), path) == [2012, 2013]
    kept = {f for f in (tmp_path / "years").rglob("*.parquet") if "year=" in str(f)}
    assert s.write_new_years(df, path) == [2014, 2015]
    assert kept <= set((tmp_path / "years").rglob("*.parquet"))
    assert s.write_new_years(df, path) == []
    whole = str(tmp_path / "whole")
    s.write_weather_master(df, whole)
    a, b = (spark.read.parquet(x).select(sorted(spark.read.parquet(whole).columns)) for x in (path, whole))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert s.write_new_years(df.withColumn("tmax", F.lit(0.0)), path, redo=[2015]) == [2015]
    assert spark.read.parquet(path).where("year = 2015").agg(F.max("tmax")).first()[0] == 0.0
    assert sorted(r.year for r in s.finished_years(spark, path).distinct().collect()) == [2012, 2013, 2014, 2015]
    assert s.write_new_years(df.limit(0), path) == []


def test_a_run_that_died_before_the_manifest_is_repeated(spark, tmp_path):
    path = str(tmp_path / "years")
    df = spark.createDataFrame([(35.0, -120.0, dt.date(2012, 3, 1), 1.0)], "latitude double, longitude double, date date, tmax double")
    s.write_weather_master(df, path)  # the months are there, the manifest is not
    assert s.write_new_years(df, path) == [2012] and spark.read.parquet(path).count() == 1


def test_summary_is_observed_while_rows_are_written(spark, tmp_path):
    df = spark.range(1000, numPartitions=7).withColumn("y", F.col("id") % 3)
    s.write_with_summary(df, str(tmp_path / "t"), str(tmp_path / "s"), F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), by=["y"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
    row = s.read_json_row(spark, str(tmp_path / "s"), "n long, top long").collect()
    assert [(r.n, r.top) for r in row] == [(1000, 999)]


def test_row_local_operators_accept_streams(spark, tmp_path):
    from firegrid.functions.spatial import with_cell
    from firegrid.operators.cleaning import in_coordinate_range, sentinels_to_null
    daily(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(daily(spark).schema).parquet(str(tmp_path / "in"))
    out = with_cell(in_coordinate_range(sentinels_to_null(stream)))
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("grid_id IS NOT NULL").count() == 80
