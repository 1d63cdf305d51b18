"""Queries over sources and sinks. Files are written from the given tables to the shared folder."""

from pyspark.sql import functions as F

from firegrid.functions.calendar import date_from_name
from firegrid.plans import sqltext as q
from firegrid.plans.catalog import query
from firegrid.session import scratch_path
from firegrid.sources import files as s

FIRE = "latitude:r longitude:r brightness:r acq_date:d confidence frp:r type:i"
FIRE_SCHEMA = ("latitude double, longitude double, brightness double, acq_date date, "
               "confidence string, frp double, type int")


def _fires(t):
    return t.fires().select("latitude", "longitude", "brightness", "acq_date", "confidence", "frp", "type")


@query("src_fire_csv", FIRE, "SELECT * FROM fire_v")
def _(t):
    path = scratch_path(t.spark, "fires")
    s.write_csv(_fires(t), path)
    return s.read_fires(t.spark, path, FIRE_SCHEMA)


@query("sink_csv", "n:i frp_sum:r first_day:d last_day:d",
       "SELECT count(*) AS n, sum(frp) AS frp_sum, min(acq_date) AS first_day, max(acq_date) AS last_day FROM fire_v")
def _(t):
    path = scratch_path(t.spark, "sink")
    s.write_csv(_fires(t), path)
    return s.read_fires(t.spark, path, FIRE_SCHEMA).agg(
        F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp_sum"),
        F.min("acq_date").alias("first_day"), F.max("acq_date").alias("last_day"))


DAY = "date:d longitude:r latitude:r ppt:r tmax:r vbdmax:r"


def _day_folders(t, weather):
    """CSV files in one folder a day (Spark names the files itself); the date is only in the folder's name."""
    path = scratch_path(t.spark, "days")
    (weather.select("longitude", "latitude", "ppt", "tmax", "vbdmax", "day")
     .repartition(t.spark.sparkContext.defaultParallelism, "day")
     .write.partitionBy("day").option("header", True).csv(path))
    return path


@query("src_weather_files", DAY, "SELECT * FROM weather_v")
def _(t):
    return s.read_weather_days(t.spark, _day_folders(t, t.weather().withColumn("day", F.date_format("date", "yyyyMMdd"))))


@query("src_weather_range", DAY, """
SELECT * FROM weather_v WHERE date BETWEEN DATE '1996-12-15' AND DATE '1999-02-10' AND station <> 2""")
def _(t):
    # folders that are no date, or no day of the calendar, are skipped
    day = F.when(F.col("station") == 2, F.concat(F.lit("199813"), F.date_format("date", "dd"))).otherwise(
        F.date_format("date", "yyyyMMdd"))
    return s.read_weather_days(
        t.spark, _day_folders(t, t.weather().withColumn("day", day)), dates=("1996-12-15", "1999-02-10"))


@query("date_from_filename", "name date:d", """
SELECT name, CASE WHEN name LIKE '%.csv' THEN CAST(strptime(substr(name, 1, 8), '%Y%m%d') AS DATE) END AS date
FROM (SELECT strftime(date, '%Y%m%d') || CASE WHEN station = 1 THEN '.txt' ELSE '.csv' END AS name FROM weather_v) n""")
def _(t):
    ending = F.when(F.col("station") == 1, ".txt").otherwise(".csv")
    names = t.weather().select(F.concat(F.date_format("date", "yyyyMMdd"), ending).alias("name"))
    return names.withColumn("date", date_from_name("name"))


BOX = """SELECT o_custkey % 50 AS part, min(latitude) AS y0, max(latitude) AS y9, min(longitude) AS x0, max(longitude) AS x9
FROM orders JOIN fire_v ON o_orderkey = fire_key GROUP BY 1"""


@query("boundary_edges", "part x1:r y1:r x2:r y2:r", f"""
WITH b AS (SELECT CAST(part AS VARCHAR) AS part, y0, y9, x0, x9 FROM ({BOX}) x WHERE part % 2 = 0)
SELECT part, x0 AS x1, y0 AS y1, x9 AS x2, y0 AS y2 FROM b UNION ALL SELECT part, x9, y0, x9, y9 FROM b
UNION ALL SELECT part, x9, y9, x0, y9 FROM b UNION ALL SELECT part, x0, y9, x0, y0 FROM b""")
def _(t):
    fires = t.fires().join(t.table("orders"), F.col("fire_key") == F.col("o_orderkey"))
    box = fires.groupBy((F.col("o_custkey") % 50).alias("part")).agg(
        F.min("latitude").alias("y0"), F.max("latitude").alias("y9"),
        F.min("longitude").alias("x0"), F.max("longitude").alias("x9"))
    ring = F.array(*[F.array(x, y) for x, y in (
        ("x0", "y0"), ("x9", "y0"), ("x9", "y9"), ("x0", "y9"), ("x0", "y0"))])
    features = box.select(
        F.lit("Feature").alias("type"),
        F.struct(F.col("part").cast("string").alias("part"),
                 F.when(F.col("part") % 2 == 0, "06").otherwise("41").alias("STATEFP")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = scratch_path(t.spark, "outline")
    features.write.json(path)
    return s.read_boundary(t.spark, path, {"STATEFP": "06"}).withColumn("part", F.col("properties")["part"])


@query("weather_master", "station date:d year:i month:i day_of_year:i grid_id week", f"""
SELECT z.*, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year, {q.week('date')} AS week
FROM ({q.cells('SELECT * FROM weather_v')}) z""")
def _(t):
    path = scratch_path(t.spark, "master")
    s.write_weather_master(t.weather(), path)
    return t.spark.read.parquet(path)


@query("scan_pushdown", "latitude:r longitude:r date:d tmax:r", """
SELECT * FROM weather_v WHERE year(date) = 1998 AND month(date) = 7 AND latitude BETWEEN 33e0 AND 40e0
 AND longitude BETWEEN -122e0 AND -115e0 AND date BETWEEN DATE '1998-07-03' AND DATE '1998-07-29'""")
def _(t):
    path = scratch_path(t.spark, "scan")
    s.write_weather_master(t.weather(), path)
    return s.scan_weather(t.spark, path, 1998, 7, (33.0, 40.0, -122.0, -115.0), ("1998-07-03", "1998-07-29"),
                          ["latitude", "longitude", "date", "tmax"])


@query("incremental_years", "year:i n_rows:i", """
SELECT year(date) AS year, count(*) AS n_rows FROM weather_v WHERE year(date) NOT IN
 (SELECT year(acq_date) FROM fire_v WHERE acq_date < DATE '1998-01-01') GROUP BY 1""")
def _(t):
    weather = t.weather().withColumn("year", F.year("date"))
    done = t.fires().where("acq_date < DATE '1998-01-01'").withColumn("year", F.year("acq_date"))
    pending = s.pending_years(weather, done)  # one row per calendar year
    return weather.join(F.broadcast(pending), "year").groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query("incremental_run", "station date:d tmax:r year:i month:i week run:i", f"""
SELECT station, date, tmax, year(date) AS year, month(date) AS month, {q.week('date')} AS week,
 CASE WHEN year(date) < 1998 THEN 1 ELSE 2 END AS run FROM weather_v""")
def _(t):
    # the second run sees every year and must leave those of the first as they are
    path, weather = scratch_path(t.spark, "years"), t.weather()
    s.write_new_years(weather.where(F.year("date") < 1998).withColumn("run", F.lit(1)), path)
    s.write_new_years(weather.withColumn("run", F.lit(2)), path)
    return t.spark.read.parquet(path)


@query("summary_json", "total_rows:i first_date:d last_date:d tmax_max:r ppt_sum:r", """
SELECT count(*) AS total_rows, min(date) AS first_date, max(date) AS last_date, max(tmax) AS tmax_max, sum(ppt) AS ppt_sum
FROM weather_v""")
def _(t):
    table, summary = scratch_path(t.spark, "observed"), scratch_path(t.spark, "summary")
    s.write_with_summary(
        t.weather(), table, summary, F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.max("tmax").alias("tmax_max"), F.sum("ppt").alias("ppt_sum"))
    return s.read_json_row(
        t.spark, summary, "total_rows long, first_date date, last_date date, tmax_max double, ppt_sum double")


@query("head_sample", "station date:d tmax:r", "SELECT station, date, tmax FROM weather_v ORDER BY date, station LIMIT 1000")
def _(t):
    return s.head_sample(t.weather(), 1000, ["date", "station"])
