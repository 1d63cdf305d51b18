"""Queries over the column functions."""

from pyspark.sql import functions as F

from firegrid.functions.calendar import mid_week, week_start, week_text
from firegrid.functions.scalar import risk_level
from firegrid.functions.spatial import haversine_km, with_cell, with_centre
from firegrid.operators.profiling import encode_objects, numeric_transform, scale_minmax
from firegrid.operators.weather import date_bins, robust_scale
from firegrid.plans import sqltext as q
from firegrid.plans.catalog import query
from firegrid.sources.files import with_calendar_and_cell


@query("utm_grid", "fire_key grid_id", q.cells("SELECT * FROM fire_v"))
def _(t):
    return with_cell(t.fires())


@query("utm_inverse", "fire_key grid_id latitude:r longitude:r",
       q.centres(f"SELECT fire_key, grid_id FROM ({q.cells('SELECT * FROM fire_v')}) g"))
def _(t):
    return with_centre(with_cell(t.fires()).select("fire_key", "grid_id"))


@query("week_period", "fire_key week", f"SELECT fire_key, {q.week('acq_date')} AS week FROM fire_v")
def _(t):
    return t.fires().withColumn("week", week_text("acq_date"))


@query("week_mid", "fire_key mid:d", f"SELECT fire_key, {q.week_start('acq_date')} + 3 AS mid FROM fire_v")
def _(t):
    return t.fires().withColumn("mid", mid_week(week_start("acq_date")))


@query("grid_time", "fire_key acq_date:d grid_id week",
       f"SELECT z.*, {q.week('acq_date')} AS week FROM ({q.cells('SELECT * FROM fire_v', 10)}) z")
def _(t):
    return with_cell(t.fires(), 10).withColumn("week", week_text("acq_date"))


@query("weather_grid", "station date:d grid_id week year:i month:i day_of_year:i", f"""
SELECT z.*, {q.week('date')} AS week, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year
FROM ({q.cells('SELECT * FROM weather_v')}) z""")
def _(t):
    return with_calendar_and_cell(t.weather())


@query("haversine", "fire_key km:r", f"SELECT fire_key, {q.haversine('latitude', 'longitude', '37e0', '-120e0')} AS km FROM fire_v")
def _(t):
    return t.fires().withColumn("km", haversine_km("latitude", "longitude", F.lit(37.0), F.lit(-120.0)))


@query("frp_log", "fire_key frp_log:r", "SELECT fire_key, ln(1e0 + frp) AS frp_log FROM fire_v")
def _(t):
    return numeric_transform(t.fires(), scale_brightness=False)


SCALED = "0.1e0 + 0.9e0*(brightness - min(brightness) OVER ())/(max(brightness) OVER () - min(brightness) OVER ())"


@query("brightness_scaled", "fire_key brightness_normalized:r zero_count:i", f"""
SELECT fire_key, b AS brightness_normalized, count(*) FILTER (WHERE b = 0e0) OVER () AS zero_count
FROM (SELECT fire_key, {SCALED} AS b FROM fire_v) s""")
def _(t):
    df = scale_minmax(t.fires(), ["brightness"], 0.1, 1.0, "scaled_").withColumnRenamed(
        "scaled_brightness", "brightness_normalized")
    zeros = df.agg(F.count_if(F.col("brightness_normalized") == 0)).scalar()
    return df.withColumn("zero_count", zeros)


@query("numeric_transform", "fire_key frp_log:r brightness_normalized:r",
       f"SELECT fire_key, ln(1e0+frp) AS frp_log, {SCALED} AS brightness_normalized FROM fire_v")
def _(t):
    return numeric_transform(t.fires())


def scaled_sql(x: str) -> str:
    return (f"({x} - median({x}) OVER (PARTITION BY date_bin)) / coalesce(nullif(quantile_cont({x}, 0.75e0) OVER (PARTITION BY date_bin)"
            f" - quantile_cont({x}, 0.25e0) OVER (PARTITION BY date_bin), 0e0), 1e0) AS normalized_{x}")


@query("robust_scale", "station date:d date_bin normalized_tmax:r normalized_ppt:r normalized_vbdmax:r",
       f"SELECT b.*, {scaled_sql('tmax')}, {scaled_sql('ppt')}, {scaled_sql('vbdmax')} FROM ({q.WEATHER_BINS}) b")
def _(t):
    return robust_scale(date_bins(t.weather()), ["tmax", "ppt", "vbdmax"])


@query("encode_objects", "fire_key confidence:i acq_date:i", """
SELECT fire_key, coalesce(code, -1) AS confidence, epoch(CAST(acq_date AS TIMESTAMP)) AS acq_date
FROM (SELECT fire_key, CASE WHEN type = 0 THEN confidence END AS conf, acq_date FROM fire_v) f
LEFT JOIN (SELECT confidence AS c, row_number() OVER (ORDER BY min(fire_key)) - 1 AS code
 FROM fire_v WHERE type = 0 GROUP BY confidence) k ON f.conf = k.c""")
def _(t):
    fires = t.fires().withColumns({
        "confidence": F.when(F.col("type") == 0, F.col("confidence")),
        "acq_date": F.col("acq_date").cast("string")})
    return encode_objects(fires, ["confidence", "acq_date"], "fire_key")


@query("risk_level", "row_key risk", """
SELECT row_key, CASE WHEN score > 0.66e0 THEN 'High' WHEN score > 0.33e0 THEN 'Medium' ELSE 'Low' END AS risk FROM score_v""")
def _(t):
    return t.scores().withColumn("risk", risk_level(F.col("score")))
