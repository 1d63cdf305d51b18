"""Queries over generators, samples, splits and folds."""

from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators import sampling as s
from firegrid.operators.polygons import edges_from_rings, lattice_cells
from firegrid.operators.profiling import numeric_transform
from firegrid.plans import sqltext as q
from firegrid.plans.adapters import OUTLINE
from firegrid.plans.catalog import query
from firegrid.plans.q_scalars import SCALED
from firegrid.session import written

KM = 10
CELLS = q.lattice(KM)
LABELLED = f"""SELECT z.*, {q.week('acq_date')} AS week FROM ({q.cells(
    f"SELECT fire_key, latitude, longitude, acq_date, ln(1e0+frp) AS frp_log, {SCALED} AS brightness_normalized FROM fire_v", KM)}) z"""


def _lattice(t):
    return lattice_cells(t.spark, edges_from_rings(t.spark, [OUTLINE]), KM)


def labelled(t, km=KM):
    return with_cell(numeric_transform(t.fires()), km).withColumn("week", week_text("acq_date"))


@query("all_grid_ids", "grid_id n_fires:i", f"""
SELECT c.grid_id, count(f.fire_key) AS n_fires FROM ({CELLS}) c
LEFT JOIN ({q.cells('SELECT * FROM fire_v', KM)}) f ON c.grid_id = f.grid_id GROUP BY c.grid_id""")
def _(t):
    hits = labelled(t).groupBy("grid_id").agg(F.count("fire_key").alias("n_fires"))
    return _lattice(t).join(hits, "grid_id", "left").withColumn("n_fires", F.coalesce("n_fires", F.lit(0)))


@query("all_weeks", "week n_fires:i", f"""
SELECT w.week, count(f.fire_key) AS n_fires
FROM (SELECT {q.week('d')} AS week FROM (SELECT unnest(generate_series(date_trunc('week', min(acq_date)), date_trunc('week', max(acq_date)), INTERVAL 7 DAY)) AS d FROM fire_v) g) w
LEFT JOIN (SELECT fire_key, {q.week('acq_date')} AS week FROM fire_v) f ON w.week = f.week GROUP BY w.week""")
def _(t):
    fires = t.fires()
    hits = fires.groupBy(week_text("acq_date").alias("week")).agg(F.count("fire_key").alias("n_fires"))
    return s.all_weeks(fires).join(hits, "week", "left").withColumn("n_fires", F.coalesce("n_fires", F.lit(0)))


def _h60(key: str, seed) -> str:
    return f"CAST('0x' || substr({q.md5(key, seed)}, 1, 15) AS BIGINT)"


NEGATIVES = q.centres(f"""
WITH cells AS ({CELLS}), pos AS (SELECT DISTINCT grid_id, week FROM ({LABELLED}) l),
numbered AS (SELECT grid_id, row_number() OVER (ORDER BY {q.md5('grid_id', 42)}) - 1 AS cell_no FROM cells),
dims AS (SELECT {q.week_start('min(acq_date)')} AS monday,
  ({q.week_start('max(acq_date)')} - {q.week_start('min(acq_date)')}) // 7 + 1 AS weeks, count(*) AS n FROM fire_v),
sizes AS (SELECT d.*, least(c * weeks, n + p) AS strata, c * weeks AS total FROM dims d,
  (SELECT count(*) AS c FROM cells) x, (SELECT count(*) AS p FROM pos) y),
draws AS (SELECT unnest(range(strata)) AS i, total // strata AS base, total % strata AS extra, weeks, monday, n FROM sizes),
picks AS (SELECT i*base + least(i, extra) + {_h60('i', 42)} % (base + CASE WHEN i < extra THEN 1 ELSE 0 END) AS pick, weeks, monday, n FROM draws),
pairs AS (SELECT c.grid_id, monday + CAST(7*(pick % weeks) AS INTEGER) AS start, n FROM picks p JOIN numbered c ON c.cell_no = pick // weeks),
named AS (SELECT grid_id, start, {q.week('start')} AS week, n FROM pairs),
free AS (SELECT f.* FROM named f WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.grid_id = f.grid_id AND p.week = f.week))
SELECT grid_id, week, start + 3 AS acq_date, 0e0 AS frp_log, 0e0 AS brightness_normalized, 0 AS fire FROM
 (SELECT f.*, row_number() OVER (ORDER BY {q.md5("(grid_id || '|' || week)", 42)}) AS rn FROM free f) r WHERE rn <= n""", KM)
SAMPLE = "grid_id week latitude:r longitude:r acq_date:d frp_log:r brightness_normalized:r fire:i"


def _negatives(t):
    n = t.fires().count()  # as many as there are detections
    return s.negative_samples(labelled(t), _lattice(t), n, 42, size_km=KM)


@query("negative_samples", SAMPLE, NEGATIVES)
def _(t):
    return _negatives(t)


FULL = f"""SELECT grid_id, week, latitude, longitude, acq_date, frp_log, brightness_normalized, 1 AS fire FROM ({LABELLED}) l
UNION ALL SELECT grid_id, week, latitude, longitude, acq_date, frp_log, brightness_normalized, fire FROM ({NEGATIVES}) g"""


@query("full_dataset", SAMPLE, FULL)
def _(t):
    return s.full_dataset(labelled(t), _negatives(t))


@query("sample_dataset", SAMPLE, f"""
SELECT * EXCLUDE (rn, half) FROM (SELECT f.*, row_number() OVER (PARTITION BY fire ORDER BY {q.md5("(grid_id || '|' || week)", 7)}) AS rn,
 (SELECT count(*) // 2 FROM fire_v) AS half FROM ({FULL}) f) r WHERE fire = 1 OR rn <= half""")
def _(t):
    full = written(s.full_dataset(labelled(t), _negatives(t)), "labelled")
    total = t.fires().agg(F.expr("count(*) + count(*) div 2")).scalar()
    return s.sample_dataset(full, total, F.concat_ws("|", "grid_id", "week"), 7)


@query("sample_rows", "fire_key frp:r", f"""
SELECT fire_key, frp FROM (SELECT f.*, row_number() OVER (ORDER BY {q.md5('fire_key', 42)}) AS rn,
 count(*) OVER () AS n FROM fire_v f) r WHERE rn <= n // 3""")
def _(t):
    fires = t.fires()
    return s.sample_rows(fires, fires.agg(F.expr("count(*) div 3")).scalar(), "fire_key")


RANKED = f"""SELECT v.*, row_number() OVER (PARTITION BY label ORDER BY {q.md5('row_key', 42)}) - 1 AS r,
 count(*) OVER (PARTITION BY label) AS n FROM score_v v"""


@query("stratified_split", "row_key label:i part", f"""
SELECT row_key, label, CASE WHEN r < 0.2e0*n THEN 'test' WHEN r < CAST({0.2 + 0.25 * 0.8!r} AS DOUBLE)*n THEN 'val' ELSE 'train' END AS part
FROM ({RANKED}) k""")
def _(t):
    return s.stratified_split(t.scores(), "row_key")


@query("stratified_folds", "row_key label:i fold:i", f"SELECT row_key, label, r % 5 AS fold FROM ({RANKED}) k")
def _(t):
    return s.stratified_folds(t.scores(), "row_key")
