import datetime as dt

import pytest
from pyspark.sql import functions as F

from firegrid.operators import cleaning as c

D = dt.date(2023, 1, 1)
FIRES = [(34.05, -118.24, 305.4), (None, -115.67, 298.1), (36.12, None, 301.0), (-91.23, 10.0, 300.0), (40.0, -120.0, 310.0)]


@pytest.fixture
def fires(spark):
    return spark.createDataFrame(FIRES, "latitude double, longitude double, brightness double")


def test_coordinates(fires):
    valid = c.valid_coordinates(fires)
    assert valid.count() == 3
    assert c.in_coordinate_range(valid).count() == 2
    with pytest.raises(ValueError, match="latitude"):
        c.valid_coordinates(fires.drop("latitude"))


def test_nulls_and_duplicates(spark, fires):
    assert c.drop_null_rows(fires).count() == 3
    assert c.drop_duplicate_rows(fires.unionByName(fires)).count() == 5


def test_sentinels_missing_and_sparse(spark):
    df = spark.createDataFrame([(D, 1.0, -9999.0, "x"), (D, -9999.0, -9999.0, None), (D, 3.0, 5.0, "y")],
                               "date date, a double, b double, t string")
    marked = c.sentinels_to_null(df)
    shares = {r.column_name: r.missing_pct for r in c.missing_share(marked).collect()}
    assert shares["a"] == pytest.approx(100 / 3) and shares["b"] == pytest.approx(200 / 3) and shares["date"] == 0
    assert c.drop_sparse_columns(marked).columns == ["date", "a", "t"]
    assert c.drop_sparse_columns(marked.select("a", "t"), 100 / 3 + 1e-9).columns == ["a", "t"]  # strictly above


def test_median_fill_per_day(spark):
    e = dt.date(2023, 1, 2)
    rows = [(D, 1.0), (D, None), (D, 4.0), (D, 9.0), (D, 2.0), (e, None), (None, 5.0), (None, None)]
    df = spark.createDataFrame(rows, "date date, a double")
    got = sorted((str(r.date), r.a) for r in c.fill_with_daily_median(df).where("a is not null").collect())
    assert (str(D), 3.0) in got and len([x for x in got if x[0] == str(D)]) == 5
    assert not [x for x in got if x[0] == str(e)]  # a day without values stays empty


def test_clean_weather_and_one_row_per_day(spark):
    rows = [(D, 34.0, -118.0, 20.0, -9999.0, -9999.0), (D, 34.0, -118.0, 20.0, -9999.0, -9999.0),
            (D, 35.0, -118.0, 22.0, 3.0, -9999.0), (D, 95.0, -118.0, 22.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, latitude double, longitude double, tmax double, ppt double, humidity double")
    got = c.clean_weather(df).collect()
    assert "humidity" not in got[0].asDict()
    assert sorted((r.latitude, r.ppt) for r in got) == [(34.0, 4.0), (35.0, 3.0)]
    twice = df.unionByName(df.withColumn("tmax", F.col("tmax") - 1))
    one = c.one_row_per_day(twice)
    assert one.count() == 3 and one.columns == df.columns
    assert {r.tmax for r in one.collect()} == {19.0, 21.0}


def test_sparse_columns_are_judged_by_day(spark):
    e = dt.date(2023, 1, 2)
    rows = [(D, i, 9.0 if i < 2 else -9999.0) for i in range(10)] + [(e, i, float(i) if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, n int, ppt double")
    got = c.clean_weather(df, keys=("n",)).collect()
    assert len(got) == 50
    assert {r.ppt for r in got if r.date == D} == {None}  # 80 % missing: empty that day, not filled
    assert [r.ppt for r in got if r.date == e and r.n == 0] == [20.0]


def test_categories_columns_and_label(spark):
    df = spark.createDataFrame([("n", 0, 1.0), ("h", 2, 0.0), ("l", 0, None), ("?", 0, 2.0)], "confidence string, type int, frp double")
    assert c.confidence_filter(df).count() == 2 and c.confidence_filter(df, False).count() == 3
    assert c.confidence_filter(df.drop("confidence")).count() == 4
    assert c.vegetation_fires(df).count() == 3
    assert c.drop_columns(df, ["type", "none"]).columns == ["confidence", "frp"]
    assert [r.fire for r in c.derive_label(df).collect()] == [1, 0, 0, 1]
    assert c.derive_label(df.withColumn("fire", F.lit(9))).first().fire == 9
    fixed = c.repair_columns(df.withColumnRenamed("frp", "longtiude"))
    assert fixed.columns[2:] == ["longitude", "frp_log", "brightness_normalized"]
    assert (fixed.first().frp_log, fixed.first().brightness_normalized) == (0.0, 0.1)
    assert c.feature_list(df, ["frp", "zzz"]) == (["frp"], ["zzz"])
    assert c.feature_list(df.withColumn("fire", F.lit(1)))[0] == ["confidence", "type", "frp"]


def test_validation(spark, fires):
    assert c.schema_message(fires.withColumn("acq_date", F.lit(D)), what="test") is None
    assert "Missing columns ['latitude', 'acq_date']" in c.schema_message(fires.drop("latitude"))
    some = spark.createDataFrame([(34.05, 1.0), (36.12, 2.0), (None, 3.0)], "latitude double, b double")
    assert c.missing_within(some, 0.4).first().ok is True
    more = spark.createDataFrame([(34.05, 1.0), (None, 2.0), (None, 3.0)], "latitude double, b double")
    assert c.missing_within(more, 0.5).first().ok is False


def test_box_and_semi(spark, fires):
    pts = spark.createDataFrame([(40.0, -120.0), (41.0, -119.0)], "latitude double, longitude double")
    near = spark.createDataFrame([(39.0, -121.0), (42.1, -119.0), (42.0, -118.0)], "latitude double, longitude double")
    assert sorted(r.latitude for r in c.in_box_of(near, pts).collect()) == [39.0, 42.0]
    w = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "1"), (None, None)], "grid_id string, week string")
    f = spark.createDataFrame([("a", "9"), ("z", "1"), ("a", "1")], "grid_id string, week string")
    assert c.keep_known_cell_or_week(w, f).count() == 2
