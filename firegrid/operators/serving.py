"""Features of a scoring request: the last day of a window of at most seven days.

These formulas differ from the training features on purpose; both are kept.
Input: ``request_id``, ``date``, ``tmax``, ``vbdmax``, ``ppt``, ``latitude``, ``longitude``;
a request holds at most ``days`` rows, so its windows are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.calendar import cycle
from firegrid.functions.scalar import bin_right_closed, flag


def _windows(weather: DataFrame, requests: DataFrame, days: int) -> DataFrame:
    """Rows of ``last_days`` with ``_block``, the stretch of ``days`` days that holds the request's day.

    A window touches two stretches at most, so the range becomes an equi-join on (location, stretch): a day of weather is
    repeated twice, and a request not at all.
    """
    def block(at: Column) -> Column:
        return F.floor(F.unix_date(at) / days)
    day, place = F.col("date"), ("latitude", "longitude", "date")
    asked = requests.select("request_id", "latitude", "longitude", day.alias("_asked"), block(day).alias("_block"))
    near = weather.withColumn("_block", F.explode(F.sequence(block(day), block(F.date_add(day, days - 1)))))
    rows = asked.join(near, ["latitude", "longitude", "_block"]).where(day.between(F.date_sub("_asked", days - 1), F.col("_asked")))
    return rows.select(*place, "request_id", *(c for c in weather.columns if c not in place), "_block")


def last_days(
    weather: DataFrame, requests: DataFrame, days: int = 7,
) -> DataFrame:
    """Weather rows of the request's location in its last ``days`` days.

    ``requests``: request_id, latitude, longitude, date.
    """
    return _windows(weather, requests, days).drop("_block")


def serve(weather: DataFrame, requests: DataFrame, days: int = 7) -> DataFrame:
    """``serving_features`` of the ``last_days`` of each request; a request id names one location and day.

    Windows keep the partitions of the join, so no row is shuffled by request.
    """
    return serving_features(_windows(weather, requests, days), ("latitude", "longitude", "_block")).drop("_block")


def serving_features(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per request, for its last day; ``within`` names columns that are equal in all rows of a request."""
    ordered = Window.partitionBy(*within, "request_id").orderBy("date")  # one order, so one sort, for all windows
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = ordered.rowsBetween(-6, 0)
    t, v, p = F.col("tmax"), F.col("vbdmax"), F.col("ppt")
    hot, dry = flag(t > 30.0), flag(p < 1.0)
    df = rows.withColumns({
        "tmax_7day_mean": F.avg(t).over(so_far),
        "ppt_7day_mean": F.avg(p).over(so_far),
        "vbd_7day_mean": F.avg(v).over(so_far),
        "high_temp_day": hot,
        "low_rain_day": dry,
        "hot_dry_day": hot * dry,
        "hot_dry_index": F.try_divide(t, F.max(t).over(every))
        * F.try_divide(F.max(p).over(every) - p, F.max(p).over(every)),
        "vpd_extreme": flag(v > 2.5),
        "_last": F.max("date").over(every),
    })
    mean_p, anomaly = F.col("ppt_7day_mean"), F.col("vbdmax") - F.col("vbd_7day_mean")
    dryness = 1.0 - F.try_divide(mean_p, F.max(mean_p).over(every))
    df = df.withColumns({
        "vpd_anomaly": anomaly,
        # a mean rain of -1 or less belongs to no class
        "drought_category": F.when(
            mean_p > -1.0, bin_right_closed(mean_p, [1, 5, 10, 20], [0, 1, 2, 3, 4])),
        "vpd_risk_category": bin_right_closed(anomaly, [-1, 1], [0, 1, 2]),
        "fire_weather_index": F.cbrt(t * v * F.col("hot_dry_index")),
        "_dwi": (anomaly + 3.0) / 6.0 * dryness,
    })
    dwi = F.col("_dwi")
    lo, hi = F.min(dwi).over(every), F.max(dwi).over(every)
    df = df.withColumn("drought_weather_index", (dwi - lo) / (hi - lo + 1e-6))
    month = F.month("date")
    week_sin, week_cos = cycle(F.weekofyear("date"), 52)
    month_sin, month_cos = cycle(month, 12)
    df = df.where(F.col("date") == F.col("_last")).withColumns({
        "fire_risk_index": (F.col("fire_weather_index") + F.col("drought_weather_index")) / 2.0,
        "is_fire_season": flag(month.between(5, 10)),
        "is_santa_ana_season": flag(month.isin(10, 11, 12, 1, 2)),
        "season": F.ceil(month / 3).cast("int"),
        "week_sin": week_sin, "week_cos": week_cos,
        "month_sin": month_sin, "month_cos": month_cos,
    })
    return df.drop("_last", "_dwi")
