import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firegrid.functions.scalar import inverse_normal, risk_level, yeo_johnson
from firegrid.operators import profiling as p


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(8)
    x = np.round(rng.exponential(2.0, 500), 2)
    x[rng.random(500) < 0.3] = 1.5
    return pd.DataFrame({"id": range(500), "x": x, "y": np.round(rng.normal(size=500), 3)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def test_describe(df, pdf):
    got = {r.variable: r for r in p.describe(df.withColumn("x", F.nullif("x", F.lit(1.5))), ["x", "y"]).collect()}
    want = pdf.x[pdf.x != 1.5].describe()
    r = got["x"]
    assert (r["count"], r.missing) == (want["count"], 500 - want["count"])
    assert np.allclose([r["mean"], r.std, r.q25, r.q50, r.q75], want[["mean", "std", "25%", "50%", "75%"]])


def test_skewness_and_correlation(df, pdf):
    r = df.agg(p.sample_skewness("x").alias("s")).first()
    assert r.s == pytest.approx(pdf.x.skew())
    got = {(r.feature_a, r.feature_b): r.correlation for r in p.correlation_matrix(df, ["x", "y"]).collect()}
    assert len(got) == 4 and got["x", "y"] == pytest.approx(pdf.x.corr(pdf.y)) and got["x", "x"] == pytest.approx(1)


def test_outliers_box_recommendation(df, pdf):
    q1, q3 = np.percentile(pdf.x, [25, 75])
    out = (pdf.x < q1 - 1.5 * (q3 - q1)) | (pdf.x > q3 + 1.5 * (q3 - q1))
    share = {r.variable: r for r in p.outlier_share(df, ["x", "y"]).collect()}["x"]
    assert share.original_pct == pytest.approx(out.mean() * 100)
    box = {r.variable: r for r in p.boxplot_stats(df, ["x"]).collect()}["x"]
    assert (box.n_outliers, box.whisker_high) == (out.sum(), pdf.x[~out].max())
    rec = {r.variable: r.method for r in p.recommend_scaler(df, ["x", "y"]).collect()}
    assert rec == {"x": "Z-Score", "y": "Min-Max"}


def test_plain_scalers(df, pdf):
    got = p.scale_zscore(p.scale_minmax(p.scale_robust(df, ["x"]), ["x"], 0.1, 1.0), ["x"]).toPandas().sort_values("id")
    assert np.allclose(got.minmax_x, 0.1 + 0.9 * (pdf.x - pdf.x.min()) / (pdf.x.max() - pdf.x.min()))
    assert np.allclose(got.zscore_x, (pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0))
    q = np.percentile(pdf.x, [25, 50, 75])
    assert np.allclose(got.robust_x, (pdf.x - q[1]) / (q[2] - q[0]))
    flat = p.scale_minmax(p.scale_zscore(df.withColumn("x", F.lit(3.0)), ["x"]), ["x"], 0.1, 1.0).first()
    assert (flat.zscore_x, flat.minmax_x) == (0.0, 0.1)


def likelihood(x, lam):
    def t(v):
        if v >= 0:
            return math.log1p(v) if abs(lam) < 1e-9 else ((v + 1) ** lam - 1) / lam
        return -math.log1p(-v) if abs(lam - 2) < 1e-9 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)
    y = np.array([t(v) for v in x])
    return -len(x) / 2 * math.log(y.var()) + (lam - 1) * sum(np.sign(x) * np.log1p(np.abs(x))), y


def test_yeo_johnson(df, pdf):
    lams = {r.variable: r.lam for r in p.yeo_johnson_lambdas(df, ["x", "y"]).collect()}
    for c in ("x", "y"):
        grid = np.arange(-4, 4, 0.01)
        best = grid[int(np.argmax([likelihood(pdf[c], g)[0] for g in grid]))]
        assert lams[c] == pytest.approx(best, abs=0.011)
    got = p.scale_yeojohnson(df, ["x"]).toPandas().sort_values("id").yeojohnson_x
    y = likelihood(pdf.x, lams["x"])[1]
    assert np.allclose(got, (y - y.mean()) / y.std())


def test_yeo_johnson_limits(spark):
    r = spark.range(1).select(
        yeo_johnson(F.lit(3.0), F.lit(0.0)).alias("a"), yeo_johnson(F.lit(-3.0), F.lit(2.0)).alias("b")).first()
    assert (r.a, r.b) == (pytest.approx(math.log(4)), pytest.approx(-math.log(4)))


def test_quantile_scaler(df, pdf):
    got = p.scale_quantile(df, ["x"]).toPandas().sort_values("id").quantile_x
    share = (pdf.x.rank() - 1) / (len(pdf) - 1)
    want = [NormalDist().inv_cdf(min(max(s, 1e-7), 1 - 1e-7)) for s in share]
    assert np.allclose(got, want, atol=1e-6)


def test_inverse_normal(spark):
    ps = [1e-7, 0.01, 0.02425, 0.3, 0.5, 0.97575, 0.999]
    rows = spark.createDataFrame([(v,) for v in ps], "p double").select(inverse_normal(F.col("p"))).collect()
    assert np.allclose([r[0] for r in rows], [NormalDist().inv_cdf(v) for v in ps], atol=1e-7)


def test_counts_histogram_hexbin(spark, df, pdf):
    counts = {r.k: (r.n, r.share) for r in p.value_counts(df.select((F.col("id") % 2).alias("k")), "k").collect()}
    assert counts == {0: (250, 0.5), 1: (250, 0.5)}
    hist = {r.bin: r.n for r in p.histogram(df, "x", 30).collect()}
    want = np.histogram(pdf.x, 30)[0]
    assert sum(hist.values()) == 500 and all(abs(hist.get(i, 0) - want[i]) <= 1 for i in range(30))
    one = p.histogram(df.withColumn("x", F.lit(2.0)), "x", 5).collect()
    assert [(r.bin, r.n) for r in one] == [(0, 500)]
    hexes = p.hexbin(df.withColumn("v", F.lit(2.0)), "v", "x", "y", 10).collect()
    assert sum(r.n for r in hexes) == 500 and all(r.mean_value == 2.0 for r in hexes) and len(hexes) > 10


def test_patterns_weights_encoding(spark):
    rows = [("a", "2013-01-07/2013-01-13", 0.9, 1), ("a", "2013-01-14/2013-01-20", 0.1, 0), ("b", "2013-01-07/2013-01-13", 0.8, 1)]
    s = spark.createDataFrame(rows, "grid_id string, week string, fire_probability double, fire_predicted int")
    top = p.top_fire_grids(s, 1).collect()
    assert (top[0].grid_id, top[0].fire_rate, top[0].std_probability) == ("b", 1.0, None)
    assert {str(r.week): r.predicted_fires for r in p.temporal_patterns(s).collect()} == {"2013-01-07": 2, "2013-01-14": 0}
    w = p.class_weight(spark.createDataFrame([(0,), (0,), (1,)], "label int")).first()
    assert (w.n_negative, w.n_positive, w.scale_pos_weight) == (2, 1, 2.0)
    e = spark.createDataFrame([(1, "z", "2020-01-01"), (2, "a", "bad"), (3, None, None), (4, "z", "1970-01-02")], "k int, c string, my_date string")
    got = {r.k: (r.c, r.my_date) for r in p.encode_objects(e, ["c", "my_date"], "k").collect()}
    assert got == {1: (0, 1577836800), 2: (1, None), 3: (-1, None), 4: (0, 86400)}
    lv = spark.createDataFrame([(0.66,), (0.661,), (0.33,), (None,)], "p double").select(risk_level(F.col("p"))).collect()
    assert [r[0] for r in lv] == ["Medium", "High", "Low", None]


def test_yeo_johnson_search_goes_past_its_first_range(spark):
    import numpy as np

    from firegrid.operators.profiling import yeo_johnson_lambdas
    rng = np.random.default_rng(2)
    z = rng.normal(10.0, 1.0, 400)
    high, low = z ** (1 / 9.0) - 1.0, 1.0 - z ** (1 / 9.0)  # best powers near 9 and 2 - 9
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(high, low)], "high double, low double, flat double")

    def likelihood(x, lam):
        y = np.where(x >= 0, ((np.abs(x) + 1) ** lam - 1) / lam if lam else np.log1p(np.abs(x)),
                     -((1 + np.abs(x)) ** (2 - lam) - 1) / (2 - lam) if lam != 2 else -np.log1p(np.abs(x)))
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    got = {r.variable: r.lam for r in yeo_johnson_lambdas(df, ["high", "low", "flat"]).collect()}
    assert set(got) == {"high", "low"}
    grid = np.arange(-40, 40, 0.01) + 0.003
    for name, x in (("high", high), ("low", low)):
        want = grid[np.argmax([likelihood(x, g) for g in grid])]
        assert abs(want) > 5 and got[name] == pytest.approx(want, abs=0.02)
