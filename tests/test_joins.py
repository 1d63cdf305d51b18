import datetime as dt

import pytest
from pyspark.sql import functions as F

from firegrid.operators import joins as j

D = dt.date


@pytest.fixture(scope="module")
def fires(spark):
    rows = [(1, 35.0, -120.0, D(2022, 1, 10)), (2, 35.0, -120.0, D(2022, 1, 15)), (3, 36.0, -119.0, D(2022, 1, 31)),
            (4, 36.0, -119.0, D(2022, 3, 1)), (5, 35.0, -120.0, D(2022, 1, 20))]
    return spark.createDataFrame(rows, "fire_key int, latitude double, longitude double, acq_date date")


@pytest.fixture(scope="module")
def weather(spark):
    rows = [(35.1, -120.0, D(2022, 1, 10), 20.0), (35.1, -120.0, D(2022, 1, 14), 21.0), (35.1, -120.0, D(2022, 1, 16), 22.0),
            (35.9, -119.1, D(2022, 2, 1), 23.0), (60.0, -119.0, D(2022, 1, 31), 24.0), (35.9, -119.1, D(2022, 1, 2), 25.0)]
    return spark.createDataFrame(rows, "latitude double, longitude double, date date, tmax double")


def test_same_day_then_fallback(fires, weather):
    got = {r.fire_key: r for r in j.merge_fire_weather(fires, weather).collect()}
    assert set(got) == {1, 2}
    assert (got[1].weather_tmax, got[1].temporal_offset_days) == (20.0, 0)
    # two days at equal offset: the earlier one
    assert (got[2].weather_tmax, got[2].temporal_offset_days, got[2].weather_date) == (21.0, 1, D(2022, 1, 14))
    assert got[1].distance_km == pytest.approx(11.1195, abs=1e-3)
    # fire 3: only a February row is near in time, and the 60 degree row is outside the box; fire 5: nothing in time


def test_repeated_station_days_do_not_double_fires(fires, weather):
    twice = weather.unionByName(weather.withColumn("tmax", F.col("tmax") + 1))
    got = {r.fire_key: r.weather_tmax for r in j.merge_fire_weather(fires, twice).collect()}
    assert got == {1: 20.0, 2: 21.0}
    assert j.nearest_station(fires, twice).count() == j.nearest_station(fires, weather).count()


def test_cross_month(fires, weather):
    both = j.nearest_station(fires, weather, keep_misses=True)
    misses = both.where(F.col("weather_date").isNull()).select(*fires.columns)
    got = {r.fire_key for r in j.temporal_fallback(misses, weather, fires, cross_month=True).collect()}
    assert got == {2, 3}


def test_overwrite_form(fires, weather):
    out = j.merge_fire_weather(fires, weather, overwrite=True)
    assert sorted(out.columns) == sorted(
        ["fire_key", "acq_date", "latitude", "longitude", "date", "tmax", "distance_km", "temporal_offset_days"])
    assert {r.latitude for r in out.collect()} == {35.1}


def test_left_asof_update(spark):
    fires = spark.createDataFrame([(1, "a", D(2022, 1, 10)), (2, "a", D(2022, 1, 12)), (3, "b", D(2022, 1, 1))],
                                  "fire_key int, grid_id string, acq_date date")
    w = spark.createDataFrame([("a", D(2022, 1, 10), 1.0), ("a", D(2022, 1, 11), 2.0), ("a", D(2022, 1, 13), 3.0)],
                              "nearest_grid_id string, date date, tmax double")
    first = j.cell_day_left_join(fires, w)
    assert {r.fire_key: r.tmax for r in first.collect()} == {1: 1.0, 2: None, 3: None}
    patch = j.asof_nearest(first.where("tmax IS NULL").select(*fires.columns), w.withColumnRenamed("nearest_grid_id", "grid_id"), "grid_id")
    assert {r.fire_key: (r.date, r.tmax) for r in patch.collect()} == {2: (D(2022, 1, 11), 2.0), 3: (None, None)}
    fixed = j.update_fill(first, patch, "fire_key", ["date", "tmax"])
    assert {r.fire_key: r.tmax for r in fixed.collect()} == {1: 1.0, 2: 2.0, 3: None}


def test_three_way(spark):
    days = [D(2023, 1, k) for k in (1, 2, 3)]
    a = spark.createDataFrame([(d, 20.0, 0.5, 3.0) for d in days], "date date, temperature double, humidity double, wind_speed double")
    b = spark.createDataFrame([(d, 0.3, 300.0) for d in days], "date date, ndvi double, lst double")
    c = spark.createDataFrame([(d, 2, 9.0) for d in days], "date date, fire_count int, total_frp double")
    out = j.three_way_join(a, b, c)
    assert (out.count(), len(out.columns)) == (3, 8)


def test_station_months_hold_days_as_bits(spark, weather):
    plain = {(r.p_lat, r._month): r._days for r in j.station_months(weather).collect()}
    assert plain[(35.1, D(2022, 1, 1))] == (1 << 25) | (1 << 29) | (1 << 31)
    spilled = {(r.p_lat, r._month): r._days for r in j.station_months(weather, 1).collect()}
    assert spilled[(35.9, D(2022, 1, 1))] == (1 << 17) | (1 << 47)  # 2 January, and 1 February seen from January
    assert spilled[(60.0, D(2022, 2, 1))] == 1 << 15
    with pytest.raises(ValueError):
        j.station_months(weather, 17)


def test_fallback_equals_brute_force(spark):
    import random
    rng = random.Random(4)
    fires = [(k, 34 + rng.randrange(8) / 4, -120 + rng.randrange(8) / 4, D(2022, rng.choice((1, 2)), rng.randrange(1, 29))) for k in range(60)]
    rows = [(33.9 + a / 3, -120.1 + b / 3, D(2022, rng.choice((1, 2, 3)), rng.randrange(1, 29))) for a in range(7) for b in range(7) for _ in range(2)]
    rows = [(*r, float(k)) for k, r in enumerate(dict.fromkeys(rows))]
    f = spark.createDataFrame(fires, "fire_key int, latitude double, longitude double, acq_date date")
    w = spark.createDataFrame(rows, "latitude double, longitude double, date date, tmax double")
    for days, cross in ((1, False), (5, False), (40, False), (5, True)):
        got = {r.fire_key: (r.weather_tmax, r.temporal_offset_days)
               for r in j.temporal_fallback(f, w, days=days, buffer=90.0, cross_month=cross).collect()}
        want = {}
        for key, lat, lon, day in fires:
            near = [(round(km(lat, lon, a, b), 6), a, b, abs((d - day).days), d, t) for a, b, d, t in rows
                    if abs((d - day).days) <= days and (cross or d.month == day.month)]
            if near:
                want[key] = (min(near)[5], min(near)[3])
        assert got == want, (days, cross)


def km(a, b, c, d):
    import math
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 12742 * math.asin(min(1.0, math.sqrt(h)))


def test_empty_and_null_inputs(spark, fires, weather):
    assert j.merge_fire_weather(fires, weather.limit(0)).count() == 0
    assert j.merge_fire_weather(fires.limit(0), weather).count() == 0
    holes = fires.unionByName(spark.createDataFrame([(9, None, -120.0, D(2022, 1, 10)), (10, 35.0, -120.0, None)], fires.schema))
    assert {r.fire_key for r in j.merge_fire_weather(holes, weather).collect()} == {1, 2}
    assert j.nearest_station(holes, weather, keep_misses=True).count() == 7


def test_weather_rows_are_shuffled_once(spark):
    """Past the stored station months, only the final join moves weather rows."""
    import re

    from firegrid.plans.adapters import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = j.merge_fire_weather(
        t.fires().select("fire_key", "latitude", "longitude", "acq_date"), t.weather().drop("station")
    )._jdf.queryExecution().executedPlan().toString()
    # one exchange of the view's own grouping, one of the join
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_suppkey", plan)) == 1


def test_merge_sends_no_growing_table_through_the_driver(spark):
    fires = spark.sql("SELECT id AS fire_key, 34.0 + id % 7 / 10e0 AS latitude, -118.0D AS longitude, DATE'2020-05-03' AS acq_date FROM range(40)")
    weather = spark.sql("SELECT 34.0 + id % 5 / 10e0 AS latitude, -118.0D AS longitude, DATE'2020-05-03' + CAST(id % 2 AS INT) AS date, 1e0 AS tmax FROM range(40)")
    out = j.merge_fire_weather(fires, weather)
    assert out.count() == 40
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
