"""Queries over summaries, distributions and scalers."""

from itertools import product

from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators import profiling as p
from firegrid.plans import sqltext as q
from firegrid.plans.catalog import query

COLS = ["tmax", "ppt", "vbdmax"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS x FROM weather_v" for c in COLS)
SCORED = f"""SELECT s.score AS fire_probability, CASE WHEN s.score >= 0.5e0 THEN 1 ELSE 0 END AS fire_predicted, c.grid_id,
 {q.week('c.acq_date')} AS week FROM score_v s JOIN ({q.cells('SELECT * FROM fire_v', 25)}) c ON s.row_key = c.fire_key"""
PATTERN = """avg(fire_probability) AS mean_probability, stddev_samp(fire_probability) AS std_probability,
 count(fire_probability) AS sample_count, sum(fire_predicted) AS predicted_fires, avg(fire_predicted) AS fire_rate"""
PATTERN_COLS = "mean_probability:a std_probability:r sample_count:i predicted_fires:i fire_rate:r"


def _scored(t):
    fires = with_cell(t.fires(), 25).select("fire_key", "grid_id", week_text("acq_date").alias("week"))
    return t.scores().join(fires, F.col("row_key") == F.col("fire_key")).select(
        "grid_id", "week", F.col("score").alias("fire_probability"),
        (F.col("score") >= 0.5).cast("int").alias("fire_predicted"))


@query("spatial_patterns", f"grid_id {PATTERN_COLS}", f"SELECT grid_id, {PATTERN} FROM ({SCORED}) s GROUP BY grid_id")
def _(t):
    return p.spatial_patterns(_scored(t))


@query("top_fire_grids", f"grid_id {PATTERN_COLS}",
       f"SELECT grid_id, {PATTERN} FROM ({SCORED}) s GROUP BY grid_id ORDER BY fire_rate DESC, grid_id LIMIT 20")
def _(t):
    return p.top_fire_grids(_scored(t))


@query("temporal_patterns", f"week:d {PATTERN_COLS}",
       f"SELECT CAST(split_part(week, '/', 1) AS DATE) AS week, {PATTERN} FROM ({SCORED}) s GROUP BY 1")
def _(t):
    return p.temporal_patterns(_scored(t))


@query("weather_summary", "variable count:i mean:r std:r min:r q25:r q50:r q75:r max:r missing:i missing_pct:r", f"""
SELECT variable, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25e0) AS q25,
 quantile_cont(x, 0.5e0) AS q50, quantile_cont(x, 0.75e0) AS q75, max(x) AS max, count(*) - count(x) AS missing,
 (count(*) - count(x)) * 100e0 / count(*) AS missing_pct
FROM (SELECT variable, nullif(x, 0e0) AS x FROM ({LONG}) l) m GROUP BY variable""")
def _(t):
    zero_missing = t.weather().withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in COLS})
    return p.describe(zero_missing, COLS)


@query("fires_by_date", "date:d n_fires:i", "SELECT acq_date AS date, count(*) AS n_fires FROM fire_v GROUP BY acq_date")
def _(t):
    return p.fires_per_day(t.fires())


def _biased(x: str) -> str:
    return (f"(SELECT avg(pow({x}-m,3))/pow(avg(pow({x}-m,2)),1.5e0) FROM (SELECT {x} FROM f) a,"
            f" (SELECT avg({x}) AS m FROM f) b)")


@query("frp_skewness", "skew_original:r skew_log:r sample_skew_original:r sample_skew_log:r", f"""
WITH f AS (SELECT frp, ln(1e0+frp) AS lf FROM fire_v)
SELECT {_biased('frp')} AS skew_original, {_biased('lf')} AS skew_log, skewness(frp) AS sample_skew_original,
 skewness(lf) AS sample_skew_log FROM f""")
def _(t):
    return p.skewness_report(p.numeric_transform(t.fires(), scale_brightness=False), "frp", "frp_log")


@query("correlation_matrix", "feature_a feature_b correlation:r", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM weather_v"
    for a, b in product(COLS, COLS)))
def _(t):
    return p.correlation_matrix(t.weather(), COLS)


STATS = f"SELECT variable, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS d FROM ({LONG}) l GROUP BY variable"
VERSIONS = f"""SELECT variable, method, value FROM (SELECT l.variable, unnest(['original','minmax','zscore']) AS method,
 unnest([x, (x-lo)/(hi-lo), (x-m)/d]) AS value FROM ({LONG}) l JOIN ({STATS}) s ON l.variable = s.variable) v"""


@query("outlier_pct", "variable original_pct:r minmax_pct:r zscore_pct:r", f"""
SELECT variable, {', '.join(f"max(pct) FILTER (WHERE method='{m}') AS {m}_pct" for m in p.METHODS)} FROM (
 SELECT v.variable, v.method, avg(CASE WHEN value < q1-1.5e0*(q3-q1) OR value > q3+1.5e0*(q3-q1) THEN 1e0 ELSE 0e0 END)*100e0 AS pct
 FROM ({VERSIONS}) v JOIN (SELECT variable, method, quantile_cont(value,0.25e0) AS q1, quantile_cont(value,0.75e0) AS q3
  FROM ({VERSIONS}) u GROUP BY 1,2) k ON v.variable=k.variable AND v.method=k.method GROUP BY 1,2) o GROUP BY variable""")
def _(t):
    return p.outlier_share(t.weather(), COLS)


@query("scaler_comparison", "method min:r max:r mean:r std:r skewness:r", f"""
SELECT method, avg(min) AS min, avg(max) AS max, avg(mean) AS mean, avg(std) AS std, avg(skew) AS skewness
FROM (SELECT variable, method, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
 skewness(value) AS skew FROM ({VERSIONS}) v GROUP BY 1, 2) s GROUP BY method""")
def _(t):
    return p.scaler_comparison(t.weather(), COLS)


@query("recommend_scaler", "variable skewness:r outlier_pct:r method", f"""
SELECT a.variable, a.skewness, b.outlier_pct, CASE WHEN abs(a.skewness) > 1e0 OR b.outlier_pct > 10e0 THEN 'Z-Score' ELSE 'Min-Max' END AS method
FROM (SELECT variable, skewness(x) AS skewness FROM ({LONG}) l GROUP BY variable) a JOIN
 (SELECT l.variable, avg(CASE WHEN x < q1-1.5e0*(q3-q1) OR x > q3+1.5e0*(q3-q1) THEN 1e0 ELSE 0e0 END)*100e0 AS outlier_pct
  FROM ({LONG}) l JOIN (SELECT variable, quantile_cont(x,0.25e0) AS q1, quantile_cont(x,0.75e0) AS q3 FROM ({LONG}) z GROUP BY 1) k
  ON l.variable = k.variable GROUP BY 1) b ON a.variable = b.variable""")
def _(t):
    return p.recommend_scaler(t.weather(), COLS)


KEY = "station date:d"


def _each(prefix: str, form: str) -> tuple[str, str]:
    cols = " ".join(f"{prefix}{c}:r" for c in COLS)
    return f"{KEY} {cols}", "SELECT w.*, " + ", ".join(
        f"{form.format(x=c)} AS {prefix}{c}" for c in COLS) + " FROM weather_v w"


@query("scale_minmax", *_each("minmax_", "({x}-min({x}) OVER ())/(max({x}) OVER ()-min({x}) OVER ())"))
def _(t):
    return p.scale_minmax(t.weather(), COLS)


@query("scale_zscore", *_each("zscore_", "({x}-avg({x}) OVER ())/stddev_pop({x}) OVER ()"))
def _(t):
    return p.scale_zscore(t.weather(), COLS)


@query("scale_robust", *_each(
    "robust_", "({x}-median({x}) OVER ())/(quantile_cont({x},0.75e0) OVER ()-quantile_cont({x},0.25e0) OVER ())"))
def _(t):
    return p.scale_robust(t.weather(), COLS)


_COARSE = q.best_lambda(LONG, " UNION ALL ".join(
    f"SELECT '{c}' AS v, CAST(i AS DOUBLE)/4e0 AS lam FROM range(-16, 17) AS g(i)" for c in COLS))


def _around(found: str, step: str) -> str:
    return q.best_lambda(LONG, f"SELECT variable AS v, lam + CAST(i AS DOUBLE)*{step} AS lam FROM ({found}) f, range(-10, 11) AS g(i)")


LAMBDAS = _around(_around(_COARSE, "0.025e0"), "0.0025e0")
POWERS = "SELECT w.station, w.date, " + ", ".join(
    f"{q.yeo_johnson(c, f'l_{c}')} AS y_{c}" for c in COLS) + f""" FROM weather_v w,
 (SELECT {', '.join(f"max(lam) FILTER (WHERE variable='{c}') AS l_{c}" for c in COLS)} FROM ({LAMBDAS}) f) k"""


@query("scale_yeojohnson", f"{KEY} yeojohnson_tmax:r yeojohnson_ppt:r yeojohnson_vbdmax:r", "SELECT station, date, " + ", ".join(
    f"(y_{c} - avg(y_{c}) OVER ())/stddev_pop(y_{c}) OVER () AS yeojohnson_{c}" for c in COLS) + f" FROM ({POWERS}) p")
def _(t):
    return p.scale_yeojohnson(t.weather(), COLS)


SHARES = "SELECT station, date, " + ", ".join(
    f"greatest(least((rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1)/2e0)/(count(*) OVER () - 1), 1e0-1e-7), 1e-7) AS p_{c}"
    for c in COLS) + " FROM weather_v"


@query("scale_quantile", f"{KEY} quantile_tmax:r quantile_ppt:r quantile_vbdmax:r", "SELECT station, date, " + ", ".join(
    f"{q.inverse_normal(f'p_{c}')} AS quantile_{c}" for c in COLS) + f" FROM ({SHARES}) s")
def _(t):
    return p.scale_quantile(t.weather(), COLS)


@query("melt_scaled", f"{KEY} variable value:r", " UNION ALL ".join(
    f"SELECT station, date, '{n}' AS variable, {e} AS value FROM weather_v" for n, e in (
        ("tmax", "tmax"), ("minmax_tmax", "(tmax-min(tmax) OVER ())/(max(tmax) OVER ()-min(tmax) OVER ())"),
        ("zscore_tmax", "(tmax-avg(tmax) OVER ())/stddev_pop(tmax) OVER ()"))))
def _(t):
    wide = p.scale_zscore(p.scale_minmax(t.weather(), ["tmax"]), ["tmax"])
    return p.melt(wide, ["station", "date"], ["tmax", "minmax_tmax", "zscore_tmax"])


for _name, _col in (("confidence_counts", "confidence"), ("type_counts", "type")):
    @query(_name, f"{_col}{':i' if _col == 'type' else ''} n:i share:r", f"""
SELECT {_col}, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM fire_v GROUP BY {_col}""")
    def _(t, column=_col):
        return p.value_counts(t.fires(), column)


@query("variable_histogram", "bin:i n:i bin_start:r bin_end:r", """
SELECT bin, count(*) AS n, min(lo+bin*w) AS bin_start, min(lo+(bin+1)*w) AS bin_end FROM (
 SELECT lo, w, CAST(least(floor((frp-lo)/w), 29e0) AS INTEGER) AS bin FROM fire_v,
 (SELECT min(frp) AS lo, (max(frp)-min(frp))/30e0 AS w FROM fire_v) b) s GROUP BY bin""")
def _(t):
    return p.histogram(t.fires(), "frp")


@query("hexbin_frp", "hex_x:r hex_y:r mean_value:a n:i center_x:r center_y:r", """
WITH b AS (SELECT min(longitude) AS x0, min(latitude) AS y0, (max(longitude)-min(longitude))/50e0 AS sx,
  (max(latitude)-min(latitude))/28e0 AS sy FROM fire_v),
 u AS (SELECT frp, x0, y0, sx, sy, (longitude-x0)/sx AS u, (latitude-y0)/sy AS v FROM fire_v, b),
 d AS (SELECT u.*, pow(u-round_even(u,0),2)+3e0*pow(v-round_even(v,0),2) < pow(u-floor(u)-0.5e0,2)+3e0*pow(v-floor(v)-0.5e0,2) AS one FROM u),
 h AS (SELECT frp, x0, y0, sx, sy, CASE WHEN one THEN CAST(round_even(u,0) AS DOUBLE) ELSE floor(u)+0.5e0 END AS hex_x,
  CASE WHEN one THEN CAST(round_even(v,0) AS DOUBLE) ELSE floor(v)+0.5e0 END AS hex_y FROM d)
SELECT hex_x, hex_y, avg(frp) AS mean_value, count(*) AS n, min(x0)+hex_x*min(sx) AS center_x, min(y0)+hex_y*min(sy) AS center_y
FROM h GROUP BY hex_x, hex_y""")
def _(t):
    return p.hexbin(t.fires(), "frp")


@query("boxplot_stats", "variable q1:r median:r q3:r whisker_low:r whisker_high:r n_outliers:i", f"""
SELECT l.variable, min(q1) AS q1, min(q2) AS median, min(q3) AS q3,
 min(x) FILTER (WHERE x BETWEEN q1-1.5e0*(q3-q1) AND q3+1.5e0*(q3-q1)) AS whisker_low,
 max(x) FILTER (WHERE x BETWEEN q1-1.5e0*(q3-q1) AND q3+1.5e0*(q3-q1)) AS whisker_high,
 count(*) FILTER (WHERE x < q1-1.5e0*(q3-q1) OR x > q3+1.5e0*(q3-q1)) AS n_outliers
FROM ({LONG}) l JOIN (SELECT variable, quantile_cont(x,0.25e0) AS q1, quantile_cont(x,0.5e0) AS q2, quantile_cont(x,0.75e0) AS q3
 FROM ({LONG}) z GROUP BY 1) k ON l.variable=k.variable GROUP BY l.variable""")
def _(t):
    return p.boxplot_stats(t.weather(), COLS)


@query("grid_count", "n_grids:i", f"SELECT count(DISTINCT grid_id) AS n_grids FROM ({q.cells('SELECT * FROM fire_v')}) z")
def _(t):
    return p.distinct_cells(with_cell(t.fires()))
