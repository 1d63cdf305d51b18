import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firegrid.functions.calendar import date_from_name, mid_week, week_start, week_text, week_text_start
from firegrid.operators import weather as w
from firegrid.operators.serving import last_days, serving_features

KEYS = ["longitude", "latitude", "date_bin"]


def frame(days=20, stations=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [dict(longitude=-120.0 + s, latitude=35.0 + s / 2, date=dt.date(2023, 1, 1) + dt.timedelta(d),
                 tmax=float(np.round(rng.uniform(10, 40), 1)), ppt=float(np.round(rng.uniform(0, 3), 1)),
                 vbdmax=float(np.round(rng.uniform(0, 5), 1)))
            for s in range(stations) for d in range(days) if rng.random() < 0.9]
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def binned(spark, pdf):
    return w.date_bins(spark.createDataFrame(pdf)).cache()


def by_key(df):
    return df.toPandas().sort_values(["longitude", "latitude", "date"]).reset_index(drop=True)


def test_date_bins(spark, pdf, binned):
    got = by_key(binned)
    first, last = pdf.date.min(), pdf.date.max()
    for r in got.itertuples():
        start = first + dt.timedelta((r.date - first).days // 7 * 7)
        assert r.date_bin == f"{start}_{min(start + dt.timedelta(6), last)}"
    whole = w.date_bins(spark.createDataFrame(pdf), None)
    assert [r.date_bin for r in whole.select("date_bin").distinct().collect()] == [f"{first}_{last}"]


def test_hot_dry(binned):
    got = by_key(w.hot_dry_index(binned))
    g = got.groupby(KEYS)
    t = (got.tmax - g.tmax.transform("min")) / (g.tmax.transform("max") - g.tmax.transform("min") + 1e-8)
    p = (got.ppt - g.ppt.transform("min")) / (g.ppt.transform("max") - g.ppt.transform("min") + 1e-8)
    assert np.allclose(got.hot_dry_index, t + 1 - p)
    assert (got.hot_dry_day == ((got.tmax > 25) & (got.ppt < 1)).astype(int)).all()


def test_spi_and_rolling(binned):
    got = by_key(w.rolling_means(w.spi(binned)))
    for _, part in got.groupby(KEYS):
        roll = part.ppt.rolling(7, min_periods=1)
        want = ((roll.sum() - roll.mean()) / roll.std().replace(0, np.nan)).fillna(0)
        assert np.allclose(part.spi_7day, want)
        cut = pd.cut(want, [-np.inf, -2, -1.5, -1, -0.5, 0.5, np.inf], labels=[5, 4, 3, 2, 1, 0]).astype(int)
        assert (part.drought_category.to_numpy() == cut.to_numpy()).all()
        assert np.allclose(part.tmax_7day_mean, part.tmax.rolling(7, min_periods=1).mean())


def test_vpd(binned):
    got = by_key(w.vpd_risk(w.vpd_extremes(binned)))
    g = got.groupby(KEYS).vbdmax
    assert (got.vpd_extreme == (got.vbdmax > g.transform(lambda x: np.percentile(x, 90))).astype(int)).all()
    assert np.allclose(got.vpd_anomaly, ((got.vbdmax - g.transform("mean")) / g.transform("std")).fillna(0))
    share = g.rank(method="first", pct=True)
    for b, part in share.groupby(got.date_bin):
        want = pd.qcut(part, 5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert (got.vpd_risk_category[part.index] == want).all(), b


def test_short_bins_keep_all_rows(spark):
    pdf = frame(days=3)
    got = w.engineer_features(spark.createDataFrame(pdf))
    assert got.count() == len(pdf) and got.where("vpd_risk_category IS NULL").count() == 0


def test_null_measures(spark):
    rows = [(-120.0, 35.0, dt.date(2023, 1, 1) + dt.timedelta(d), None, 1.0 if d else None, None) for d in range(3)]
    df = spark.createDataFrame(rows, "longitude double, latitude double, date date, tmax double, ppt double, vbdmax double")
    got = by_key(w.engineer_features(df))
    assert (got.high_temp_day == 0).all() and list(got.low_rain_day) == [0, 0, 0]
    assert (got.vpd_extreme == 0).all() and (got.vpd_anomaly == 0).all() and (got.spi_7day == 0).all()
    assert got.vpd_risk_category.isna().all() and list(got.drought_category) == [1, 1, 1]


def test_robust_scale(spark, binned):
    got = by_key(w.robust_scale(binned, ["tmax"]))
    for _, part in got.groupby("date_bin"):
        q1, q2, q3 = np.percentile(part.tmax, [25, 50, 75])
        assert np.allclose(part.normalized_tmax, (part.tmax - q2) / ((q3 - q1) or 1))
    flat = w.robust_scale(binned.withColumn("tmax", F.lit(5.0)), ["tmax"], by=())
    assert {r.normalized_tmax for r in flat.collect()} == {0.0}


def test_compound_fallbacks(binned):
    hot = w.compound_indices(w.hot_dry_index(binned)).first()
    assert hot.fire_weather_index == hot.drought_weather_index == hot.fire_risk_index
    none = w.compound_indices(binned).first()
    assert (none.fire_weather_index, none.drought_weather_index, none.fire_risk_index) == (1.0, 1.0, 1.0)
    wind = w.compound_indices(w.vpd_risk(w.spi(w.hot_dry_index(binned))).withColumn("wind_risk", F.lit(4)))
    r = by_key(wind)
    g = r.groupby(KEYS).hot_dry_index
    heat = 5 * (r.hot_dry_index - g.transform("min")) / (g.transform("max") - g.transform("min") + 1e-8)
    assert np.allclose(r.fire_risk_index, 0.25 * (heat + r.vpd_risk_category + r.drought_category + 4))


def test_switches_and_missing_columns(spark, pdf):
    opts = w.Features(hot_dry=False, compound=False, scaled=False, temporal=False, rolling=False, vpd=False)
    assert set(w.engineer_features(spark.createDataFrame(pdf), opts).columns) - set(pdf.columns) == {
        "date_bin", "spi_7day", "drought_category"}
    few = w.engineer_features(spark.createDataFrame(pdf.drop(columns=["vbdmax"])))
    assert "normalized_vbdmax" not in few.columns and few.first().vbd_7day_mean is None


def test_temporal(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 15),) for m in range(1, 13)], "date date")
    got = w.temporal_features(df).toPandas()
    assert list(got.season) == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]
    assert list(got.is_fire_season) == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert list(got.is_santa_ana_season) == [1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1]
    assert np.allclose(got.week_sin, np.sin(2 * np.pi * (got.day_of_year // 7) / 52))


def test_weeks(spark):
    df = spark.createDataFrame([(dt.date(2013, 1, 1),), (dt.date(2013, 1, 6),), (dt.date(2013, 1, 7),), (None,)], "d date")
    rows = df.select(week_text("d").alias("t"), mid_week(week_start("d")).alias("m")).collect()
    assert rows[0].t == rows[1].t == "2012-12-31/2013-01-06" and rows[2].t.startswith("2013-01-07/")
    assert rows[0].m == dt.date(2013, 1, 3)
    back = df.where("d IS NOT NULL").select(week_text_start(week_text("d")).alias("s")).first()
    assert back.s == dt.date(2012, 12, 31)
    names = spark.createDataFrame([("20130105.csv",), ("20131405.csv",), ("x.csv",), ("20130105.txt",)], "n string")
    assert [r[0] for r in names.select(date_from_name("n")).collect()] == [dt.date(2013, 1, 5), None, None, None]


def test_serving(spark):
    first = dt.date(2024, 6, 24)
    tmax, vpd, ppt = [31.0, 28.0, 35.0, 33.0, 29.0, 30.0, 36.0], [1.0, 2.0, 3.0, 4.0, 2.0, 1.0, 4.0], [0.0, 2.0, 0.0, 4.0, 1.0, 0.0, 0.5]
    days = [(35.0, -120.0, first + dt.timedelta(i), t, v, p) for i, (t, v, p) in enumerate(zip(tmax, vpd, ppt))]
    days.append((35.0, -120.0, first - dt.timedelta(1), 99.0, 9.0, 9.0))  # outside the window
    weather = spark.createDataFrame(days, "latitude double, longitude double, date date, tmax double, vbdmax double, ppt double")
    req = spark.createDataFrame([("r", 35.0, -120.0, first + dt.timedelta(6))], "request_id string, latitude double, longitude double, date date")
    got = serving_features(last_days(weather, req)).collect()
    assert len(got) == 1
    r = got[0]
    means = [np.mean(ppt[: i + 1]) for i in range(7)]
    anomaly = [v - np.mean(vpd[: i + 1]) for i, v in enumerate(vpd)]
    dwi = [(a + 3) / 6 * (1 - m / max(means)) for a, m in zip(anomaly, means)]
    hot_dry = 36 / 36 * (4 - 0.5) / 4
    assert r.hot_dry_index == pytest.approx(hot_dry) and r.vpd_anomaly == pytest.approx(anomaly[-1])
    assert r.fire_weather_index == pytest.approx((36 * 4 * hot_dry) ** (1 / 3))
    assert r.drought_weather_index == pytest.approx((dwi[-1] - min(dwi)) / (max(dwi) - min(dwi) + 1e-6))
    assert r.fire_risk_index == pytest.approx((r.fire_weather_index + r.drought_weather_index) / 2)
    assert (r.drought_category, r.vpd_risk_category, r.season, r.is_fire_season, r.is_santa_ana_season) == (1, 2, 2, 1, 0)
    assert r.week_sin == pytest.approx(math.sin(2 * math.pi * 26 / 52))


def test_location_key_parts_locations_like_the_coordinates(spark):
    from firegrid.operators.weather import with_location_key
    rows = [(0.0, 1.0), (-0.0, 1.0), (1.0, 0.0), (None, 1.0), (1.0, None), (None, None), (float("nan"), 1.0), (1e-300, 1.0), (0.1 + 0.2, 1.0), (0.3, 1.0)]
    df = with_location_key(spark.createDataFrame(rows * 2, "longitude double, latitude double"))
    by = df.groupBy("longitude", "latitude").agg(F.count_distinct("location_key").alias("keys"), F.first("location_key").alias("key")).collect()
    assert len(by) == 9 and all(r["keys"] == 1 for r in by) and len({r["key"] for r in by}) == 9


def test_requests_meet_their_days_by_stretches(spark):
    from firegrid.operators.serving import serve
    rng, first = np.random.default_rng(3), dt.date(1969, 12, 1)
    days = [(float(lat), -0.0 if lat else 0.0, first + dt.timedelta(int(d)), float(rng.integers(20, 40)), float(rng.integers(0, 5)), float(rng.integers(0, 9)))
            for lat in range(3) for d in np.flatnonzero(rng.random(60) < 0.4)]
    days.append((1.0, -0.0, None, 1.0, 1.0, 1.0))
    weather = spark.createDataFrame(days, "latitude double, longitude double, date date, tmax double, vbdmax double, ppt double")
    req = [(f"{lat}|{d}", lat, 0.0, first + dt.timedelta(d)) for lat in (0.0, 1.0, 2.0, 7.0, None) for d in range(-3, 70)] + [("x", 1.0, 0.0, None)]
    requests = spark.createDataFrame(req, "request_id string, latitude double, longitude double, date date")
    asked = requests.select("request_id", "latitude", "longitude", F.explode(F.sequence(F.date_sub("date", 6), F.col("date"))).alias("date"))
    plain = asked.join(weather, ["latitude", "longitude", "date"])
    got, served = last_days(weather, requests), serve(weather, requests)
    key = lambda r: (r.request_id, str(r.date))
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    want = serving_features(plain)
    assert served.columns == want.columns and sorted(served.collect(), key=key) == sorted(want.collect(), key=key)
    plan = served._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and "request_id" in x for x in plan.splitlines())


def test_feature_windows_sort_twice(spark, pdf):
    opts = w.Features(scaled=False)
    plan = w.engineer_features(spark.createDataFrame(pdf), opts)._jdf.queryExecution().executedPlan().toString()
    windows = plan[plan.index("Window"):]
    assert sum("Sort [" in x for x in windows.splitlines()) == 2


def test_six_places_is_round(spark):
    from firegrid.plans.catalog import six_places
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=20000), rng.normal(size=2000) * 1e9, rng.integers(-9999, 9999, 5000) / 1e4 + 5e-7, rng.integers(-99, 99, 500) / 2e6,
                        rng.integers(-10**9, 10**9, 5000) * 1e-7, [0.0, -0.0, -1e-9, 1e300, -1e300, np.inf, -np.inf, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    both = df.select(six_places(F.col("x")).alias("a"), F.round("x", 6).alias("b"))
    assert both.where("NOT a <=> b").count() == 0
