"""Fire-to-weather matching and the smaller join patterns.

Fires: ``latitude``, ``longitude``, ``acq_date`` (a date) and a unique ``fire_key``.
Weather: ``latitude``, ``longitude``, ``date`` and measures, one row per location and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.cleaning import bounding_box
from firegrid.operators.nearest import nearest_point
from firegrid.session import written

POSITION_DAY = ["latitude", "longitude", "acq_date"]
BEFORE = 16  # bit of the first day of a month; days of the month before take the bits below


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _bits(first: Column, last: Column) -> Column:
    """Mask of the bits ``first`` to ``last``."""
    return F.aggregate(F.sequence(first.cast("int"), last.cast("int")), F.lit(0).cast("long"), lambda m, at: m.bitwiseOR(_bit(at)))


def station_months(weather: DataFrame, spill: int = 0) -> DataFrame:
    """(p_lat, p_lon, _month, _days): the days on which a station reports, as bits of one row a month.

    Bit 16 is the first day of ``_month`` (its first date). With ``spill``, at most 16, the last
    ``spill`` days of the month before and the first of the month after have bits too.
    """
    if not 0 <= spill <= BEFORE:
        raise ValueError(f"at most {BEFORE} days across a month's border, not {spill}")
    months = [F.trunc(F.date_add("date", k), "month") for k in sorted({-spill, 0, spill})]
    return (
        weather.select(F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), "date",
                       F.explode(F.array_distinct(F.array(*months))).alias("_month"))
        .groupBy("p_lat", "p_lon", "_month")
        .agg(F.bit_or(_bit(F.datediff("date", "_month") + BEFORE)).alias("_days")))


def _in_month_box(stations: DataFrame, fires: DataFrame, buffer: float) -> DataFrame:
    """Station months inside the buffered box of that month's fires, stored."""
    dated = fires.withColumn("_month", F.trunc("acq_date", "month"))
    boxes = bounding_box(dated, buffer, ["_month"])  # one row per calendar month
    return written(
        stations.join(F.broadcast(boxes), "_month")
        .where(F.col("p_lat").between(F.col("lat_lo"), F.col("lat_hi"))
               & F.col("p_lon").between(F.col("lon_lo"), F.col("lon_hi")))
        .drop("lat_lo", "lat_hi", "lon_lo", "lon_hi"), "boxed-stations")


def _asked(fires: DataFrame) -> DataFrame:
    """Distinct places and days of the fires, with the month and the day's bit, stored."""
    return written(fires.select(*POSITION_DAY).distinct().withColumn("_month", F.trunc("acq_date", "month")).withColumn(
        "_at", F.datediff("acq_date", "_month") + BEFORE), "asked-days")


def _same_day(fires: DataFrame, stations: DataFrame, buffer: float) -> DataFrame:
    """(place, day, p_lat, p_lon, distance_km, p_date, off): the nearest station of the month.

    Stations are searched by year, with the months they report in as bits. ``p_date`` is NULL
    where the station has no row that day, which its bits tell before weather is read.
    """
    end = F.dayofmonth(F.last_day("_month"))
    month = _bit(F.month("_month"))
    boxed = _in_month_box(stations, fires, buffer).where(  # reports of its own days
        F.col("_days").bitwiseAND(_bits(F.lit(BEFORE), end + BEFORE - 1)) != 0)
    asked = _asked(fires).withColumns({"_year": F.year("_month"), "_want": month})
    near = nearest_point(
        asked, boxed.withColumns({"_year": F.year("_month"), "_has": month}), ["_year"], want="_want", has="_has")
    found = asked.join(near.hint("merge"), ["_year", "latitude", "longitude", "_want"]).join(boxed.hint("merge"), ["p_lat", "p_lon", "_month"])
    hit = F.col("_days").bitwiseAND(_bit(F.col("_at"))) != 0
    return found.select(
        *POSITION_DAY, "p_lat", "p_lon", "distance_km", F.when(hit, F.col("acq_date")).alias("p_date"),
        F.when(hit, F.lit(0)).alias("off"))


def _near_in_time(asked_fires: DataFrame, all_fires: DataFrame, stations: DataFrame, days: int, buffer: float) -> DataFrame:
    """(place, day, p_lat, p_lon, distance_km, p_date, off): the nearest station with a row within ``days``."""
    last = 2 * BEFORE + 30
    at = F.col("_at")
    asked = _asked(asked_fires).withColumn(
        "_want", _bits(F.greatest(F.lit(0), at - days), F.least(F.lit(last), at + days)))
    boxed = _in_month_box(stations, all_fires, buffer)
    near = nearest_point(asked, boxed, ["_month"], want="_want", has="_days")
    found = asked.join(near.hint("merge"), ["_month", "latitude", "longitude", "_want"]).join(boxed.hint("merge"), ["p_lat", "p_lon", "_month"])
    there = F.filter(
        F.sequence(F.greatest(-at, F.lit(-days)), F.least(F.lit(last) - at, F.lit(days))),
        lambda k: F.col("_days").bitwiseAND(_bit(F.col("_at") + k)) != 0)
    least = F.array_min(F.transform(there, lambda k: F.struct(F.abs(k).alias("off"), k.alias("k"))))
    return found.withColumn("_k", least).select(
        *POSITION_DAY, "p_lat", "p_lon", "distance_km",
        F.date_add("acq_date", F.col("_k.k")).alias("p_date"), F.col("_k.off").alias("off"))


def _with_weather(fires: DataFrame, chosen: DataFrame, weather: DataFrame, how: str = "inner") -> DataFrame:
    """Fires with the weather row of the station and day chosen for their place and day.

    Of several rows of a station and day the least one counts, so a fire is never doubled.
    Only rows that some fire asks for are aggregated. Stored tables are small on disk and large
    in memory, so none is sent whole through the driver.
    """
    measures = [c for c in weather.columns if c not in ("latitude", "longitude", "date")]
    place = ["p_lat", "p_lon", "p_date"]
    rows = weather.select(
        F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), F.col("date").alias("p_date"),
        F.struct(F.lit(0).alias("_any"), *measures).alias("_w"))
    least = rows.join(chosen.select(*place).hint("merge"), place, "left_semi").groupBy(*place).agg(F.min("_w").alias("_w"))
    found = chosen.join(least.hint("merge"), place).hint("merge").alias("c")
    same = (F.col("f.latitude") == F.col("c.latitude")) & (F.col("f.longitude") == F.col("c.longitude")) & (
        F.col("f.acq_date") == F.col("c.acq_date"))
    return fires.alias("f").join(found, same, how).select(
        *[F.col(f"f.{c}") for c in fires.columns],
        F.col("c.p_lat").alias("weather_latitude"), F.col("c.p_lon").alias("weather_longitude"),
        F.col("c.p_date").alias("weather_date"),
        *[F.col(f"c._w.{c}").alias(f"weather_{c}") for c in measures],
        F.col("c.distance_km").alias("distance_km"), F.col("c.off").alias("temporal_offset_days"))


def nearest_station(
    fires: DataFrame, weather: DataFrame, buffer: float = 1.0, keep_misses: bool = False
) -> DataFrame:
    """Join each fire to the same-day row of the nearest station of its month.

    Adds ``weather_*``, ``distance_km`` and ``temporal_offset_days`` = 0. A fire whose nearest
    station has no row that day is a miss: dropped, or kept with NULLs.
    """
    stations = written(station_months(weather), "station-months")
    chosen = written(_same_day(fires, stations, buffer).where(F.col("p_date").isNotNull()), "choice")
    return _with_weather(fires, chosen, weather, "left" if keep_misses else "inner")


def temporal_fallback(
    misses: DataFrame, weather: DataFrame, all_fires: DataFrame | None = None,
    days: int = 1, buffer: float = 1.0, cross_month: bool = False,
) -> DataFrame:
    """Nearest point among the weather rows within ``days`` of the fire.

    The search sees one row per station and month with its days as bits, never the weather
    rows. Of several days at the same point the smallest offset wins, then the earliest date.
    Fires without any row are dropped. ``cross_month`` allows at most 16 days.
    """
    stations = written(station_months(weather, days if cross_month else 0), "station-months")
    misses = written(misses, "misses")
    chosen = written(_near_in_time(misses, misses if all_fires is None else all_fires, stations, days, buffer), "choice")
    return _with_weather(misses, chosen, weather)


def merge_fire_weather(
    fires: DataFrame, weather: DataFrame, days: int = 1, buffer: float = 1.0,
    cross_month: bool = False, overwrite: bool = False,
) -> DataFrame:
    """Same-day match of the nearest station, else the temporal fallback, else dropped.

    ``overwrite=True`` gives the published form, where weather columns replace fire columns
    of the same name. Station and day are chosen per place and day of the fires, stored once,
    and joined with the weather rows once, for hits and misses together.
    """
    stations = written(station_months(weather, days if cross_month else 0), "station-months")
    first = written(_same_day(fires, stations, buffer), "first-choice")
    hits = first.where(F.col("p_date").isNotNull())
    places = fires.select(*POSITION_DAY).distinct()
    misses = places.join(hits.select(*POSITION_DAY).hint("merge"), POSITION_DAY, "left_anti")
    chosen = written(hits.unionByName(_near_in_time(misses, fires, stations, days, buffer)), "choice")
    out = _with_weather(fires, chosen, weather)
    if not overwrite:
        return out
    plain = {c[len("weather_"):]: c for c in out.columns if c.startswith("weather_")}
    kept = [F.col(c) for c in fires.columns if c not in plain]
    return out.select(*kept, *[F.col(c).alias(n) for n, c in plain.items()],
                      "distance_km", "temporal_offset_days")


def cell_day_left_join(fires: DataFrame, weather: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Left equi-join on (cell, day); ``weather`` carries ``nearest_grid_id`` and ``date``."""
    on = (fires[cell] == weather["nearest_grid_id"]) & (fires["acq_date"] == weather["date"])
    return fires.join(weather, on, "left")


def asof_nearest(
    left: DataFrame, right: DataFrame, key: str, days: int = 1,
    left_date: str = "acq_date", right_date: str = "date", left_id: str = "fire_key",
) -> DataFrame:
    """For each left row the right row of the same key with the nearest date within ``days``.

    Ties go to the earlier date. Right rows are first reduced to the best one per (key, target
    day), so the join adds at most one row per left row. Unmatched left rows are kept.
    """
    rest = [c for c in right.columns if c not in (key, right_date)]
    offsets = F.array(*[F.lit(k) for k in range(-days, days + 1)])
    best = (
        right.withColumn("_o", F.explode(offsets))
        .withColumn("_day", F.date_add(right_date, F.col("_o")))
        .groupBy(F.col(key).alias("_key"), "_day")
        .agg(F.min(F.struct(F.abs("_o").alias("off"), F.col(right_date), *rest)).alias("_r"))
    )
    joined = left.join(best, (left[key] == best["_key"]) & (left[left_date] == best["_day"]), "left")
    return joined.select(
        *left.columns, F.col(f"_r.{right_date}").alias(right_date),
        *[F.col(f"_r.{c}").alias(c) for c in rest])


def update_fill(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` of ``base`` where ``patch`` has a value for the same key."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = base.join(p, base[key] == F.col("_k"), "left")
    fixed = {c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(fixed).select(*base.columns)


def three_way_join(weather: DataFrame, satellite: DataFrame, fires: DataFrame, on: str = "date") -> DataFrame:
    return weather.join(satellite, on).join(fires, on)


def fire_keys(fires: DataFrame, cell: str = "grid_id", week: str = "week") -> DataFrame:
    """One row: number of distinct cells, weeks and (cell, week) pairs of the fires."""
    return fires.agg(
        F.count_distinct(cell).alias("n_grids"), F.count_distinct(week).alias("n_weeks"),
        F.count_distinct(cell, week).alias("n_pairs"))
