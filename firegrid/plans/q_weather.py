"""Queries over the weather features."""

from pyspark.sql import functions as F

from firegrid.operators import weather as w
from firegrid.operators.serving import serve
from firegrid.plans import sqltext as q
from firegrid.plans.catalog import query
from firegrid.plans.q_scalars import scaled_sql
from firegrid.session import scratch_path
from firegrid.sources.files import write_location_table

KEY = "station date:d date_bin"
B, LOC = q.WEATHER_BINS, q.LOC
ROLL = f"({LOC} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def _minmax(x: str) -> str:
    return f"({x} - min({x}) OVER ({LOC}))/(max({x}) OVER ({LOC}) - min({x}) OVER ({LOC}) + 1e-8)"


HOT = f"""{_minmax('tmax')} + (1e0 - {_minmax('ppt')}) AS hot_dry_index,
 CASE WHEN tmax > 25e0 THEN 1 ELSE 0 END AS high_temp_day, CASE WHEN ppt < 1e0 THEN 1 ELSE 0 END AS low_rain_day,
 CASE WHEN tmax > 25e0 AND ppt < 1e0 THEN 1 ELSE 0 END AS hot_dry_day"""
SPI = f"""coalesce((sum(ppt) OVER {ROLL} - avg(ppt) OVER {ROLL}) / nullif(stddev_samp(ppt) OVER {ROLL}, 0e0), 0e0) AS spi_7day"""
DROUGHT = """CASE WHEN spi_7day<=-2e0 THEN 5 WHEN spi_7day<=-1.5e0 THEN 4 WHEN spi_7day<=-1e0 THEN 3
 WHEN spi_7day<=-0.5e0 THEN 2 WHEN spi_7day<=0.5e0 THEN 1 ELSE 0 END AS drought_category"""
VPD = f"""CASE WHEN vbdmax > quantile_cont(vbdmax, 0.9e0) OVER ({LOC}) THEN 1 ELSE 0 END AS vpd_extreme,
 coalesce((vbdmax - avg(vbdmax) OVER ({LOC})) / nullif(stddev_samp(vbdmax) OVER ({LOC}), 0e0), 0e0) AS vpd_anomaly"""
SHARE = f"""CAST(row_number() OVER ({LOC} ORDER BY vbdmax, date) AS DOUBLE) / count(vbdmax) OVER ({LOC}) AS share"""
RISK = """CASE WHEN share<=e[1] THEN 1 WHEN share<=e[2] THEN 2 WHEN share<=e[3] THEN 3 WHEN share<=e[4] THEN 4 ELSE 5 END AS vpd_risk_category"""
MEANS = f"""avg(tmax) OVER {ROLL} AS tmax_7day_mean, avg(ppt) OVER {ROLL} AS ppt_7day_mean, avg(vbdmax) OVER {ROLL} AS vbd_7day_mean"""
TIME = """month(date) AS month, dayofyear(date) AS day_of_year,
 CASE WHEN month(date) BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_fire_season,
 CASE WHEN month(date) >= 10 OR month(date) <= 4 THEN 1 ELSE 0 END AS is_santa_ana_season,
 CASE WHEN month(date) IN (12,1,2) THEN 0 WHEN month(date) IN (3,4,5) THEN 1 WHEN month(date) IN (6,7,8) THEN 2 ELSE 3 END AS season,
 sin(2e0*pi()*(dayofyear(date)//7)/52e0) AS week_sin, cos(2e0*pi()*(dayofyear(date)//7)/52e0) AS week_cos,
 sin(2e0*pi()*month(date)/12e0) AS month_sin, cos(2e0*pi()*month(date)/12e0) AS month_cos,
 sin(2e0*pi()*dayofyear(date)/365e0) AS day_of_year_sin, cos(2e0*pi()*dayofyear(date)/365e0) AS day_of_year_cos"""
TIME_COLS = ("month:i day_of_year:i is_fire_season:i is_santa_ana_season:i season:i week_sin:r week_cos:r "
             "month_sin:r month_cos:r day_of_year_sin:r day_of_year_cos:r")
RANKED = f"""SELECT r.*, e FROM (SELECT b.*, {SHARE} FROM ({B}) b) r
 JOIN (SELECT date_bin AS eb, quantile_cont(share, [0.2e0,0.4e0,0.6e0,0.8e0]) AS e
  FROM (SELECT date_bin, {SHARE} FROM ({B}) b) s GROUP BY date_bin) k ON r.date_bin = k.eb"""
COMPOUND = """0.5e0*heat + 0.5e0*vpd_risk_category AS fire_weather_index,
 0.7e0*drought_category + 0.3e0*heat AS drought_weather_index,
 0.33e0*heat + 0.33e0*vpd_risk_category + 0.34e0*drought_category AS fire_risk_index"""
STEP1 = f"SELECT r.*, {RISK}, {HOT}, {SPI}, {VPD}, {MEANS} FROM ({RANKED}) r"
STEP2 = f"SELECT s.*, {DROUGHT}, 5e0*{_minmax('hot_dry_index')} AS heat FROM ({STEP1}) s"


@query("date_bins", KEY, B)
def _(t):
    return w.date_bins(t.weather())


@query("hot_dry_index", f"{KEY} hot_dry_index:r high_temp_day:i low_rain_day:i hot_dry_day:i",
       f"SELECT b.*, {HOT} FROM ({B}) b")
def _(t):
    return w.hot_dry_index(w.date_bins(t.weather()))


@query("spi_7day", f"{KEY} spi_7day:r drought_category:i",
       f"SELECT s.*, {DROUGHT} FROM (SELECT b.*, {SPI} FROM ({B}) b) s")
def _(t):
    return w.spi(w.date_bins(t.weather()))


@query("vpd_extreme", f"{KEY} vpd_extreme:i vpd_anomaly:r", f"SELECT b.*, {VPD} FROM ({B}) b")
def _(t):
    return w.vpd_extremes(w.date_bins(t.weather()))


@query("vpd_risk_category", f"{KEY} vpd_risk_category:i", f"SELECT r.*, {RISK} FROM ({RANKED}) r")
def _(t):
    return w.vpd_risk(w.date_bins(t.weather()))


@query("temporal_features", f"station date:d {TIME_COLS}", f"SELECT b.*, {TIME} FROM weather_v b")
def _(t):
    return w.temporal_features(t.weather())


@query("rolling_means", f"{KEY} tmax_7day_mean:r ppt_7day_mean:r vbd_7day_mean:r", f"SELECT b.*, {MEANS} FROM ({B}) b")
def _(t):
    return w.rolling_means(w.date_bins(t.weather()))


@query("compound_indices", f"{KEY} fire_weather_index:r drought_weather_index:r fire_risk_index:r",
       f"SELECT s.*, {COMPOUND} FROM ({STEP2}) s")
def _(t):
    df = w.date_bins(t.weather())
    return w.compound_indices(w.vpd_risk(w.spi(w.hot_dry_index(df))))


FEATURE_COLS = (
    f"{KEY} latitude:r longitude:r tmax:r ppt:r vbdmax:r hot_dry_index:r high_temp_day:i low_rain_day:i hot_dry_day:i "
    f"spi_7day:r drought_category:i vpd_extreme:i vpd_anomaly:r vpd_risk_category:i {TIME_COLS} "
    "tmax_7day_mean:r ppt_7day_mean:r vbd_7day_mean:r fire_weather_index:r drought_weather_index:r "
    "fire_risk_index:r normalized_tmax:r normalized_ppt:r normalized_vbdmax:r")


@query("engineer_features", FEATURE_COLS,
       f"SELECT s.*, {COMPOUND}, {TIME}, {scaled_sql('tmax')}, {scaled_sql('ppt')}, {scaled_sql('vbdmax')} FROM ({STEP2}) s")
def _(t):
    return w.engineer_features(t.weather())


@query("features_from_locations", FEATURE_COLS,
       f"SELECT s.*, {COMPOUND}, {TIME}, {scaled_sql('tmax')}, {scaled_sql('ppt')}, {scaled_sql('vbdmax')} FROM ({STEP2}) s")
def _(t):
    path = scratch_path(t.spark, "locations")
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    table = write_location_table(t.weather(), "locations_" + path[-32:], path, buckets)
    return w.engineer_features(table).drop("location_key")


@query("feature_run_summary", "total_rows_processed:i first_date:d last_date:d total_date_range_days:i "
       "chunk_interval_days:i total_chunks_processed:i", f"""
SELECT count(*) AS total_rows_processed, min(date) AS first_date, max(date) AS last_date,
 max(date) - min(date) AS total_date_range_days, 7 AS chunk_interval_days,
 count(DISTINCT date_bin) AS total_chunks_processed FROM ({B}) b""")
def _(t):
    return w.feature_run_summary(t.weather())


EV = "(PARTITION BY request_id)"
UPTO = "(PARTITION BY request_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
SERVE1 = f"""SELECT x.*, avg(tmax) OVER {UPTO} AS tmax_7day_mean, avg(ppt) OVER {UPTO} AS ppt_7day_mean,
 avg(vbdmax) OVER {UPTO} AS vbd_7day_mean, max(date) OVER {EV} AS last_day,
 tmax/nullif(max(tmax) OVER {EV}, 0e0) * ((max(ppt) OVER {EV} - ppt)/nullif(max(ppt) OVER {EV}, 0e0)) AS hot_dry_index
 FROM (SELECT CAST(r.station AS VARCHAR) || '|' || CAST(r.date AS VARCHAR) AS request_id, w.*
  FROM weather_v r JOIN weather_v w ON r.latitude=w.latitude AND r.longitude=w.longitude
  AND w.date BETWEEN r.date - 6 AND r.date) x"""
SERVE2 = f"""SELECT y.*, vbdmax - vbd_7day_mean AS vpd_anomaly, cbrt(tmax*vbdmax*hot_dry_index) AS fire_weather_index,
 (vbdmax - vbd_7day_mean + 3e0)/6e0 * (1e0 - ppt_7day_mean/nullif(max(ppt_7day_mean) OVER {EV}, 0e0)) AS dwi FROM ({SERVE1}) y"""
SERVE3 = f"""SELECT z.*, (dwi - min(dwi) OVER {EV})/(max(dwi) OVER {EV} - min(dwi) OVER {EV} + 1e-6) AS drought_weather_index FROM ({SERVE2}) z"""


@query("serving_features", "request_id date:d tmax:r ppt:r vbdmax:r hot_dry_index:r high_temp_day:i low_rain_day:i "
       "hot_dry_day:i drought_category:i vpd_extreme:i vpd_anomaly:r vpd_risk_category:i is_fire_season:i "
       "is_santa_ana_season:i season:i week_sin:r week_cos:r month_sin:r month_cos:r tmax_7day_mean:r ppt_7day_mean:r "
       "vbd_7day_mean:r fire_weather_index:r drought_weather_index:r fire_risk_index:r latitude:r longitude:r", f"""
SELECT v.*, CASE WHEN tmax>30e0 THEN 1 ELSE 0 END AS high_temp_day, CASE WHEN ppt<1e0 THEN 1 ELSE 0 END AS low_rain_day,
 CASE WHEN tmax>30e0 AND ppt<1e0 THEN 1 ELSE 0 END AS hot_dry_day, CASE WHEN vbdmax>2.5e0 THEN 1 ELSE 0 END AS vpd_extreme,
 CASE WHEN ppt_7day_mean<=-1e0 THEN NULL WHEN ppt_7day_mean<=1e0 THEN 0 WHEN ppt_7day_mean<=5e0 THEN 1
  WHEN ppt_7day_mean<=10e0 THEN 2 WHEN ppt_7day_mean<=20e0 THEN 3 ELSE 4 END AS drought_category,
 CASE WHEN vpd_anomaly<=-1e0 THEN 0 WHEN vpd_anomaly<=1e0 THEN 1 ELSE 2 END AS vpd_risk_category,
 CASE WHEN month(date) BETWEEN 5 AND 10 THEN 1 ELSE 0 END AS is_fire_season,
 CASE WHEN month(date) IN (10,11,12,1,2) THEN 1 ELSE 0 END AS is_santa_ana_season,
 (month(date)+2)//3 AS season, sin(2e0*pi()*weekofyear(date)/52e0) AS week_sin, cos(2e0*pi()*weekofyear(date)/52e0) AS week_cos,
 sin(2e0*pi()*month(date)/12e0) AS month_sin, cos(2e0*pi()*month(date)/12e0) AS month_cos,
 (fire_weather_index + drought_weather_index)/2e0 AS fire_risk_index
FROM ({SERVE3}) v WHERE date = last_day""")
def _(t):
    weather = t.weather()
    requests = weather.select(
        F.concat_ws("|", F.col("station").cast("string"), F.col("date").cast("string")).alias("request_id"),
        "latitude", "longitude", "date")
    return serve(weather, requests)
