"""Queries over the joins."""

from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators import joins as j
from firegrid.plans import sqltext as q
from firegrid.plans.catalog import query

MATCH = ("fire_key latitude:r longitude:r acq_date:d weather_latitude:r weather_longitude:r weather_date:d "
         "weather_tmax:r weather_ppt:r weather_vbdmax:r distance_km:r temporal_offset_days:i")
WEATHER = "SELECT w.*, year(date) AS y, month(date) AS m FROM weather_v w"
BOX = """SELECT year(acq_date) AS y, month(acq_date) AS m, min(latitude)-1e0 AS a, max(latitude)+1e0 AS b,
 min(longitude)-1e0 AS c, max(longitude)+1e0 AS d FROM fire_v GROUP BY 1, 2"""
BOXED = f"""SELECT w.* FROM ({WEATHER}) w JOIN ({BOX}) x ON w.y=x.y AND w.m=x.m
 AND w.latitude BETWEEN a AND b AND w.longitude BETWEEN c AND d"""
NEAR = f"""SELECT f.*, s.latitude AS plat, s.longitude AS plon,
 round({q.haversine('f.latitude', 'f.longitude', 's.latitude', 's.longitude')}, 6) AS km
 FROM (SELECT DISTINCT year(acq_date) AS y, month(acq_date) AS m, latitude, longitude FROM fire_v) f
 JOIN (SELECT DISTINCT y, m, latitude, longitude FROM ({BOXED}) b) s ON f.y=s.y AND f.m=s.m
 QUALIFY row_number() OVER (PARTITION BY f.y, f.m, f.latitude, f.longitude ORDER BY km, plat, plon) = 1"""
FIRST = f"""SELECT f.fire_key, f.latitude, f.longitude, f.acq_date, w.latitude AS weather_latitude,
 w.longitude AS weather_longitude, w.date AS weather_date, w.tmax AS weather_tmax, w.ppt AS weather_ppt,
 w.vbdmax AS weather_vbdmax, n.km AS distance_km, 0 AS temporal_offset_days
FROM fire_v f JOIN ({NEAR}) n ON year(f.acq_date)=n.y AND month(f.acq_date)=n.m AND f.latitude=n.latitude AND f.longitude=n.longitude
JOIN weather_v w ON w.latitude=n.plat AND w.longitude=n.plon AND w.date=f.acq_date"""
SECOND = f"""SELECT f.fire_key, f.latitude, f.longitude, f.acq_date, w.latitude AS weather_latitude,
 w.longitude AS weather_longitude, w.date AS weather_date, w.tmax AS weather_tmax, w.ppt AS weather_ppt,
 w.vbdmax AS weather_vbdmax, round({q.haversine('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude')}, 6) AS distance_km,
 abs(w.date - f.acq_date) AS temporal_offset_days
FROM fire_v f JOIN ({BOXED}) w ON w.y=year(f.acq_date) AND w.m=month(f.acq_date) AND w.date BETWEEN f.acq_date - 1 AND f.acq_date + 1
WHERE f.fire_key NOT IN (SELECT fire_key FROM ({FIRST}) g)
QUALIFY row_number() OVER (PARTITION BY f.fire_key ORDER BY distance_km, w.latitude, w.longitude, temporal_offset_days, w.date) = 1"""


def _inputs(t):
    fires = t.fires().select("fire_key", "latitude", "longitude", "acq_date")
    return fires, t.weather().drop("station")


@query("nearest_station", MATCH, FIRST)
def _(t):
    return j.nearest_station(*_inputs(t))


@query("temporal_fallback", MATCH, SECOND)
def _(t):
    fires, weather = _inputs(t)
    both = j.nearest_station(fires, weather, keep_misses=True)
    misses = both.where(F.col("weather_date").isNull()).select(*fires.columns)
    return j.temporal_fallback(misses, weather, fires)


PUBLISHED = ("fire_key acq_date:d latitude:r longitude:r date:d tmax:r ppt:r vbdmax:r distance_km:r "
             "temporal_offset_days:i")


@query("merge_overwrite", PUBLISHED, f"""
SELECT fire_key, acq_date, weather_latitude AS latitude, weather_longitude AS longitude, weather_date AS date,
 weather_tmax AS tmax, weather_ppt AS ppt, weather_vbdmax AS vbdmax, distance_km, temporal_offset_days
FROM (SELECT * FROM ({FIRST}) a UNION ALL SELECT * FROM ({SECOND}) b) m""")
def _(t):
    return j.merge_fire_weather(*_inputs(t), overwrite=True)


# the month of the fire chooses the box, whatever the month of the weather row
ACROSS = f"""SELECT f.fire_key, f.latitude, f.longitude, f.acq_date, w.latitude AS weather_latitude,
 w.longitude AS weather_longitude, w.date AS weather_date, w.tmax AS weather_tmax, w.ppt AS weather_ppt,
 w.vbdmax AS weather_vbdmax, round({q.haversine('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude')}, 6) AS distance_km,
 abs(w.date - f.acq_date) AS temporal_offset_days
FROM fire_v f JOIN ({BOX}) x ON x.y=year(f.acq_date) AND x.m=month(f.acq_date)
JOIN weather_v w ON w.date BETWEEN f.acq_date - 2 AND f.acq_date + 2 AND w.latitude BETWEEN a AND b AND w.longitude BETWEEN c AND d
WHERE f.fire_key NOT IN (SELECT fire_key FROM ({FIRST}) g)
QUALIFY row_number() OVER (PARTITION BY f.fire_key ORDER BY distance_km, w.latitude, w.longitude, temporal_offset_days, w.date) = 1"""


@query("merge_cross_month", MATCH, f"SELECT * FROM ({FIRST}) a UNION ALL SELECT * FROM ({ACROSS}) b")
def _(t):
    return j.merge_fire_weather(*_inputs(t), days=2, cross_month=True)


@query("merge_fire_weather", MATCH, f"SELECT * FROM ({FIRST}) a UNION ALL SELECT * FROM ({SECOND}) b")
def _(t):
    return j.merge_fire_weather(*_inputs(t))


CELL_FIRES = q.cells("SELECT fire_key, latitude, longitude, acq_date FROM fire_v", 50)
CELL_WEATHER = f"""SELECT grid_id AS nearest_grid_id, date, max(tmax) AS tmax, min(ppt) AS ppt
 FROM ({q.cells('SELECT * FROM weather_v', 50)}) c GROUP BY 1, 2"""
ASOF = f"""SELECT f.fire_key, f.acq_date, w.date, w.tmax, w.ppt FROM ({CELL_FIRES}) f LEFT JOIN ({CELL_WEATHER}) w
 ON f.grid_id = w.nearest_grid_id AND w.date BETWEEN f.acq_date - 1 AND f.acq_date + 1
 QUALIFY row_number() OVER (PARTITION BY f.fire_key ORDER BY abs(w.date - f.acq_date), w.date) = 1"""
EXACT = f"""SELECT f.fire_key, f.grid_id, f.acq_date, w.date, w.tmax, w.ppt FROM ({CELL_FIRES}) f
 LEFT JOIN ({CELL_WEATHER}) w ON f.grid_id = w.nearest_grid_id AND f.acq_date = w.date"""


def _cells(t):
    fires = with_cell(t.fires(), 50).select("fire_key", "acq_date", "grid_id")
    weather = with_cell(t.weather(), 50, out="nearest_grid_id").groupBy("nearest_grid_id", "date").agg(
        F.max("tmax").alias("tmax"), F.min("ppt").alias("ppt"))
    return fires, weather


@query("grid_date_left_join", "fire_key grid_id acq_date:d date:d tmax:r ppt:r", EXACT)
def _(t):
    return j.cell_day_left_join(*_cells(t))


@query("asof_nearest", "fire_key acq_date:d date:d tmax:r ppt:r", ASOF)
def _(t):
    fires, weather = _cells(t)
    return j.asof_nearest(fires, weather.withColumnRenamed("nearest_grid_id", "grid_id"), "grid_id")


@query("update_fill", "fire_key acq_date:d date:d tmax:r ppt:r", f"""
SELECT e.fire_key, e.acq_date, coalesce(a.date, e.date) AS date, coalesce(a.tmax, e.tmax) AS tmax,
 coalesce(a.ppt, e.ppt) AS ppt FROM ({EXACT}) e LEFT JOIN ({ASOF}) a ON e.fire_key = a.fire_key""")
def _(t):
    fires, weather = _cells(t)
    first = j.cell_day_left_join(fires, weather)
    unmatched = first.where(F.col("tmax").isNull()).select(*fires.columns)
    patch = j.asof_nearest(unmatched, weather.withColumnRenamed("nearest_grid_id", "grid_id"), "grid_id")
    return j.update_fill(first, patch, "fire_key", ["date", "tmax", "ppt"])


@query("three_way_join", "date:d temperature:a humidity:a n_records:i lst:r fire_count:i total_frp:r", """
SELECT w.date, temperature, humidity, n_records, lst, fire_count, total_frp
FROM (SELECT date, avg(tmax) AS temperature, avg(vbdmax) AS humidity FROM weather_v GROUP BY date) w
JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n_records, max(l_extendedprice) AS lst FROM lineitem GROUP BY 1) s ON w.date=s.date
JOIN (SELECT acq_date AS date, count(*) AS fire_count, sum(frp) AS total_frp FROM fire_v GROUP BY 1) f ON w.date=f.date""")
def _(t):
    weather = t.weather().groupBy("date").agg(F.avg("tmax").alias("temperature"), F.avg("vbdmax").alias("humidity"))
    satellite = t.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n_records"), F.max("l_extendedprice").alias("lst"))
    fires = t.fires().groupBy(F.col("acq_date").alias("date")).agg(
        F.count(F.lit(1)).alias("fire_count"), F.sum("frp").alias("total_frp"))
    return j.three_way_join(weather, satellite, fires)


@query("fire_keys", "n_grids:i n_weeks:i n_pairs:i", f"""
SELECT count(DISTINCT grid_id) AS n_grids, count(DISTINCT week) AS n_weeks, count(DISTINCT grid_id || week) AS n_pairs
FROM (SELECT z.grid_id, {q.week('acq_date')} AS week FROM ({q.cells('SELECT * FROM fire_v', 10)}) z) k""")
def _(t):
    return j.fire_keys(with_cell(t.fires(), 10).withColumn("week", week_text("acq_date")))


@query("union_chunks", "fire_id latitude:r longitude:r acq_date:d frp:r tmax:r", """
SELECT CAST(fire_key AS VARCHAR) AS fire_id, latitude, longitude, acq_date, frp, NULL AS tmax FROM fire_v
UNION ALL SELECT NULL, latitude, longitude, date, NULL, tmax FROM weather_v""")
def _(t):
    fires = t.fires().select(
        F.col("fire_key").cast("string").alias("fire_id"), "latitude", "longitude", "acq_date", "frp")
    weather = t.weather().select("latitude", "longitude", F.col("date").alias("acq_date"), "tmax")
    return fires.unionByName(weather, allowMissingColumns=True)
