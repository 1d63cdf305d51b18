"""Queries over the learner. Features are derived from orders and their line items.

SQL cannot grow trees; it states what any right model must give: the rows of each part, areas above chance, probabilities in
[0, 1] that agree with the predicted class, importances that sum to 1, equal scores after a round trip. The permutation
importance takes a closed-form scorer, so SQL gives its numbers.
"""

from pyspark.sql import functions as F

from firegrid.operators import modelling as m
from firegrid.operators.evaluation import curve_areas
from firegrid.plans.catalog import query
from firegrid.plans.q_sampling import RANKED
from firegrid.session import scratch_path, written

FEATURES = ["brightness", "latitude", "longitude", "month", "score"]
FAST = {"learning_rate": 0.5, "n_estimators": 30}  # fewer, larger steps than published; all other settings as published
CUT, REPEATS = 0.3, 10


def training_rows(t):
    """Labels of ``scores`` with the fire measures of the same key, stored once."""
    fires = t.fires().select(
        "fire_key", "brightness", "latitude", "longitude", F.month("acq_date").cast("double").alias("month"))
    rows = t.scores().join(fires, F.col("row_key") == F.col("fire_key"))
    return written(rows.select("row_key", "label", "split", *FEATURES), "training")


def _model(rows):
    return m.train(rows.where("split <> 'test'").withColumn("held", F.col("split") == "val"), FEATURES, params=FAST, validation="held")


@query("train_gbt", "split n_rows:i positives:i above_chance", """
SELECT split, count(*) AS n_rows, sum(label) AS positives, TRUE AS above_chance FROM score_v GROUP BY split""")
def _(t):
    rows = training_rows(t)
    scored = written(m.score(rows, _model(rows)), "scored")
    sizes = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"))
    areas = curve_areas(scored, ["split"], "label", "fire_probability")
    return sizes.join(areas, "split").withColumn("above_chance", F.col("roc_auc") > 0.5)


@query("cv_auc", "fold n_rows:i positives:i above_chance", f"""
SELECT CAST(r % 5 AS VARCHAR) AS fold, count(*) AS n_rows, sum(label) AS positives, TRUE AS above_chance FROM ({RANKED}) k GROUP BY r % 5
UNION ALL SELECT 'mean', count(*), sum(label), TRUE FROM score_v
UNION ALL SELECT 'std', count(*), sum(label), TRUE FROM score_v""")
def _(t):
    folds = written(m.cv_auc(training_rows(t), FEATURES, "row_key", params=FAST), "fold-areas")
    own = folds.select(F.col("fold").cast("string").alias("fold"), F.col("rows").alias("n_rows"), "positives", (F.col("roc_auc") > 0.5).alias("above_chance"))
    return own.union(m.cv_summary(folds).select(F.inline(F.array(
        F.struct(F.lit("mean").alias("fold"), F.col("rows").alias("n_rows"), "positives", (F.col("mean") > 0.5).alias("above_chance")),
        F.struct(F.lit("std").alias("fold"), F.col("rows").alias("n_rows"), "positives", F.col("std").between(0.0, 0.2).alias("above_chance"))))))


@query("score_batch", "row_key in_range agrees", "SELECT row_key, TRUE AS in_range, TRUE AS agrees FROM score_v")
def _(t):
    rows = training_rows(t)
    p = F.col("fire_probability")
    return m.score(rows, _model(rows)).select(
        "row_key", p.between(0.0, 1.0).alias("in_range"), (F.col("fire_predicted") == (p >= 0.5).cast("int")).alias("agrees"))


@query("feature_importance", "feature positive total:r", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', TRUE, 1e0)" for f in FEATURES)
       + ") v(feature, positive, total) WHERE EXISTS (SELECT 1 FROM score_v)")
def _(t):
    top = m.feature_importance(_model(training_rows(t)), t.spark)
    return top.withColumn("total", top.agg(F.sum("importance")).scalar()).withColumn("positive", F.col("importance") >= 0.0)


_DONOR = f"""
SELECT b.label, r.repeat, b.score, b.brightness, d.score AS d_score, d.brightness AS d_brightness
FROM numbered b, (SELECT n, repeat, list_min(list_filter(range(a0, a0 + 1000), lambda x: gcd(x, n) = 1)) AS a, (repeat + 1) * 7919 % n AS o
 FROM (SELECT n, repeat, n * ((repeat + 1) * 618033989 % 1000000000) // 1000000000 + 1 AS a0
  FROM range({REPEATS}) t(repeat), (SELECT count(*) AS n FROM score_v) c) s) r, numbered d
WHERE d.rank = (r.a * b.rank + r.o) % r.n"""


def _hit(score: str, brightness: str) -> str:
    return f"CASE WHEN (CASE WHEN {score} + ({brightness}-290e0)/1000e0 >= {CUT}e0 THEN 1 ELSE 0 END) = label THEN 1e0 ELSE 0e0 END"


@query("permutation_importance", "feature importance:r std:r", f"""
WITH numbered AS (SELECT label, score, brightness, row_number() OVER (ORDER BY md5(CAST(row_key AS VARCHAR) || '|42')) - 1 AS rank
 FROM score_v JOIN fire_v ON fire_key = row_key), pairs AS ({_DONOR}),
hits AS (SELECT 'score' AS feature, repeat, avg({_hit('d_score', 'brightness')}) AS acc FROM pairs GROUP BY repeat
 UNION ALL SELECT 'brightness', repeat, avg({_hit('score', 'd_brightness')}) FROM pairs GROUP BY repeat)
SELECT feature, avg(f - acc) AS importance, stddev_pop(f - acc) AS std
FROM hits, (SELECT avg({_hit('score', 'brightness')}) AS f FROM numbered) x GROUP BY feature""")
def _(t):
    def rule(df):
        return df.withColumn("fire_predicted", (F.col("score") + (F.col("brightness") - 290.0) / 1000.0 >= CUT).cast("int"))
    return m.permutation_importance(training_rows(t), rule, "row_key", repeats=REPEATS, features=["score", "brightness"])


@query("model_roundtrip", "n_rows:i n_equal:i", "SELECT count(*) AS n_rows, count(*) AS n_equal FROM score_v")
def _(t):
    rows = training_rows(t)
    model = _model(rows)
    path = scratch_path(t.spark, "model")
    m.save_model(model, path)
    again = m.load_model(path)
    a = m.score(rows, model).select("row_key", F.col("fire_probability").alias("p"))
    b = m.score(rows, again).select("row_key", F.col("fire_probability").alias("q"))
    return a.join(b, "row_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p") == F.col("q")).alias("n_equal"))
