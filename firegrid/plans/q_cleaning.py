"""Queries over the cleaning operators."""

from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators import cleaning as c
from firegrid.operators.polygons import edges_from_rings, within_polygon
from firegrid.plans import sqltext as q
from firegrid.plans.adapters import OUTLINE
from firegrid.plans.catalog import query

RAW = "row_key date:d latitude:r longitude:r tmax:r ppt:r vbdmax:r humidity:r"
RAW_LIST = "row_key, date, latitude, longitude, tmax, ppt, vbdmax, humidity"
FIRE = "fire_key latitude:r longitude:r brightness:r frp:r confidence type:i acq_date:d"
MARKED = """SELECT row_key, date, latitude, longitude, nullif(tmax,-9999e0) AS tmax, nullif(ppt,-9999e0) AS ppt,
 nullif(vbdmax,-9999e0) AS vbdmax, nullif(humidity,-9999e0) AS humidity FROM raw_weather_v"""


def _half_missing(t):
    """Fires with coordinates knocked out by type and confidence."""
    return t.fires().withColumns({
        "latitude": F.when(F.col("confidence") != "l", F.col("latitude")),
        "longitude": F.when(F.col("type") == 0, F.col("longitude"))})


HALF = """SELECT fire_key, CASE WHEN confidence<>'l' THEN latitude END AS latitude,
 CASE WHEN type=0 THEN longitude END AS longitude, brightness, frp, confidence, type, acq_date FROM fire_v"""


@query("drop_nulls", RAW, f"SELECT * FROM ({MARKED}) m WHERE ppt IS NOT NULL AND vbdmax IS NOT NULL AND humidity IS NOT NULL")
def _(t):
    return c.drop_null_rows(c.sentinels_to_null(t.raw_weather()))


@query("drop_dups", RAW, "SELECT DISTINCT * FROM (SELECT * FROM raw_weather_v UNION ALL SELECT * FROM raw_weather_v) u")
def _(t):
    return c.drop_duplicate_rows(t.raw_weather().unionByName(t.raw_weather()))


@query("valid_coords", FIRE, f"SELECT * FROM ({HALF}) h WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return c.valid_coordinates(_half_missing(t))


@query("coord_range", RAW, "SELECT * FROM raw_weather_v WHERE latitude BETWEEN -90e0 AND 90e0 AND longitude BETWEEN -180e0 AND 180e0")
def _(t):
    return c.in_coordinate_range(t.raw_weather())


@query("sentinel_null", RAW, MARKED)
def _(t):
    return c.sentinels_to_null(t.raw_weather())


@query("missing_pct", "column_name missing_pct:r", " UNION ALL ".join(
    f"SELECT '{x}' AS column_name, avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END)*100e0 AS missing_pct FROM ({MARKED}) m"
    for x in RAW_LIST.split(", ")))
def _(t):
    return c.missing_share(c.sentinels_to_null(t.raw_weather()))


@query("drop_sparse_cols", RAW.replace(" humidity:r", ""), MARKED)
def _(t):
    return c.drop_sparse_columns(c.sentinels_to_null(t.raw_weather()))


FILLED = f"""SELECT row_key, date, latitude, longitude, tmax,
 coalesce(ppt, median(ppt) OVER (PARTITION BY date)) AS ppt,
 coalesce(vbdmax, median(vbdmax) OVER (PARTITION BY date)) AS vbdmax FROM ({MARKED}) m"""


@query("median_fill", RAW.replace(" humidity:r", ""), FILLED)
def _(t):
    marked = c.sentinels_to_null(t.raw_weather()).drop("humidity")
    return c.fill_with_daily_median(marked, ["ppt", "vbdmax"])


# A column missing in more than half of a day's rows is empty that day, else filled by the day's median.
CLEANED = "SELECT row_key, date, latitude, longitude, tmax, " + ", ".join(
    f"""CASE WHEN avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY date) * 100e0 <= 50e0
 THEN coalesce({x}, median({x}) OVER (PARTITION BY date)) END AS {x}""" for x in ("ppt", "vbdmax", "humidity")) + f" FROM ({MARKED}) m"


@query("clean_weather", RAW,
       f"SELECT DISTINCT * FROM ({CLEANED}) f WHERE latitude BETWEEN -90e0 AND 90e0 AND longitude BETWEEN -180e0 AND 180e0")
def _(t):
    clean = c.clean_weather(t.raw_weather(), keys=("row_key",))
    # humidity is only there if some day keeps it
    return clean if "humidity" in clean.columns else clean.withColumn("humidity", F.lit(None).cast("double"))


@query("confidence_filter", FIRE, "SELECT * FROM fire_v WHERE confidence IN ('n','h')")
def _(t):
    return c.confidence_filter(t.fires())


@query("type_filter", FIRE, "SELECT * FROM fire_v WHERE type = 0")
def _(t):
    return c.vegetation_fires(t.fires())


@query("drop_cols", "fire_key latitude:r longitude:r frp:r confidence acq_date:d",
       "SELECT fire_key, latitude, longitude, frp, confidence, acq_date FROM fire_v")
def _(t):
    return c.drop_columns(t.fires(), ["type", "brightness", "scan", "not_there"])


@query("repair_columns", "fire_key longitude:r frp:r frp_log:r brightness_normalized:r",
       "SELECT fire_key, longitude, frp, 0e0 AS frp_log, 0.1e0 AS brightness_normalized FROM fire_v")
def _(t):
    return c.repair_columns(t.fires().withColumnRenamed("longitude", "longtiude"))


@query("derive_label", "fire_key frp:r fire:i",
       "SELECT fire_key, frp - 200e0 AS frp, CASE WHEN frp - 200e0 > 0e0 THEN 1 ELSE 0 END AS fire FROM fire_v")
def _(t):
    return c.derive_label(t.fires().withColumn("frp", F.col("frp") - 200.0))


@query("select_features", "fire_key brightness:r frp:r", "SELECT fire_key, brightness, frp FROM fire_v")
def _(t):
    return c.select_features(t.fires(), ["brightness", "frp", "not_there"], keep=("fire_key",))


@query("within_polygon", FIRE, f"SELECT * FROM fire_v WHERE {q.inside()}")
def _(t):
    return within_polygon(t.fires(), edges_from_rings(t.spark, [OUTLINE]))


@query("within_polygon_cells", FIRE, f"SELECT * FROM fire_v WHERE {q.inside()}")
def _(t):
    return within_polygon(t.fires(), edges_from_rings(t.spark, [OUTLINE]), small=0)


@query("bbox_filter", "station date:d latitude:r longitude:r tmax:r", """
SELECT w.* FROM weather_v w, (SELECT min(latitude) a, max(latitude) b, min(longitude) c, max(longitude) d
 FROM fire_v) x WHERE w.latitude BETWEEN a+0.5e0 AND b-0.5e0 AND w.longitude BETWEEN c+0.5e0 AND d-0.5e0""")
def _(t):
    return c.in_box_of(t.weather(), t.fires(), buffer=-0.5)


@query("semi_or_filter", "station date:d grid_id week", f"""
WITH w AS (SELECT z.*, {q.week('date')} AS week FROM ({q.cells('SELECT * FROM weather_v', 25)}) z),
 f AS (SELECT z.*, {q.week('acq_date')} AS week FROM ({q.cells("SELECT * FROM fire_v", 25)}) z)
SELECT * FROM w WHERE grid_id IN (SELECT grid_id FROM f) OR week IN (SELECT week FROM f)""")
def _(t):
    w = with_cell(t.weather(), 25).withColumn("week", week_text("date"))
    f = with_cell(t.fires(), 25).withColumn("week", week_text("acq_date"))
    return c.keep_known_cell_or_week(w, f)


@query("schema_check", "what n_rows:i message", """
SELECT 'fires' AS what, count(*) AS n_rows, 'ok' AS message FROM fire_v
UNION ALL SELECT 'weather', count(*), 'Missing columns [''brightness'', ''acq_date''] in weather' FROM weather_v""")
def _(t):
    parts = []
    for what, df in (("fires", t.fires()), ("weather", t.weather())):
        message = c.schema_message(df, what=what) or "ok"
        parts.append(df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n_rows"),
                            F.lit(message).alias("message")))
    return parts[0].unionByName(parts[1])


@query("missing_ok", "worst_share:r ok", f"""
SELECT worst_share, worst_share <= 0.1e0 AS ok FROM (SELECT greatest(avg(CASE WHEN ppt IS NULL THEN 1e0 ELSE 0e0 END),
 avg(CASE WHEN vbdmax IS NULL THEN 1e0 ELSE 0e0 END)) AS worst_share FROM ({MARKED}) m) s""")
def _(t):
    return c.missing_within(c.sentinels_to_null(t.raw_weather()).select("ppt", "vbdmax"), 0.1)
