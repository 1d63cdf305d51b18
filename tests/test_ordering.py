import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.operators import ordering as o
from firegrid.operators.quantiles import exact_quantiles

PROBS = [0.1, 0.25, 0.5, 0.9]


def skewed(n=4000, seed=1):
    """One group holds most rows, one value holds a third of them, one value is an outlier."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    x = np.round(rng.normal(size=n), 3)
    x[rng.random(n) < 0.34] = 0.5
    x[0] = 1e12
    return pd.DataFrame({"day": g, "x": x})


@pytest.mark.parametrize("steps", [1, 8])
def test_quantiles_equal_numpy_for_any_ranges(spark, steps):
    pdf = skewed()
    got = exact_quantiles(spark.createDataFrame(pdf), ["x"], PROBS, ["day"], steps).toPandas()
    for row in got.itertuples():
        want = np.quantile(pdf[pdf.day == row.day].x, PROBS)
        assert np.allclose([row.q0, row.q1, row.q2, row.q3], want, atol=1e-12), row.day
        assert row.n == (pdf.day == row.day).sum()
    assert set(got.day) == set(pdf.day)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_quantiles_small_lists(spark, values):
    rows = [(None if v is None else float(v),) for v in values]
    got = exact_quantiles(spark.createDataFrame(rows, "x double"), ["x"], PROBS, steps=2).collect()
    known = [v for (v,) in rows if v is not None]
    if not known:
        assert got == []
        return
    assert np.allclose([got[0][f"q{k}"] for k in range(4)], np.quantile(known, PROBS), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_total(spark, descending):
    pdf = skewed().groupby(["day", "x"]).size().rename("c").reset_index()
    got = o.running_total(spark.createDataFrame(pdf), ["day"], "x", ["c"], descending).toPandas()
    got = got.sort_values(["day", "x"], ascending=[True, not descending])
    assert len(got) == len(pdf)
    assert (got.groupby("day").c.cumsum() == got.cum_c).all()


def test_running_total_spreads_a_hot_group(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("x"))
    sizes = o.with_bucket(df, "x").groupBy("_bucket").count().toPandas()
    assert len(sizes) > 900 and sizes["count"].max() < 200


def test_hash_rank_is_a_permutation_and_repeats(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("g"))
    a = o.hash_rank(df, ["g"], "id", 7, size="n").toPandas()
    for _, part in a.groupby("g"):
        assert sorted(part.hash_rank) == list(range(len(part))) and (part.n == len(part)).all()
    b = o.hash_rank(df.repartition(13), ["g"], "id", 7, below=F.lit(50)).toPandas()
    want = a[a.hash_rank < 50]
    assert set(zip(b.id, b.hash_rank)) == set(zip(want.id, want.hash_rank))


def test_null_groups_are_kept(spark):
    df = spark.range(30).select("id", F.when(F.col("id") % 3 == 0, "a").alias("g"), F.col("id").cast("double").alias("x"))
    ranked = o.hash_rank(df, ["g"], "id", 7, size="n").toPandas()
    assert len(ranked) == 30 and sorted(ranked[ranked.g.isna()].hash_rank) == list(range(20))
    total = o.running_total(df, ["g"], "x", ["id"]).toPandas()
    assert len(total) == 30 and total[total.g.isna()].cum_id.max() == sum(i for i in range(30) if i % 3)
    q = {r.g: r.q0 for r in exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert q == {"a": 13.5, None: 15.0}  # 14 and 16 are the middle of the others


def test_missed_brackets_are_widened(spark, monkeypatch):
    """A sketch that is far off gives the same quantiles, after wider rounds."""
    from firegrid.operators import quantiles as q
    right, rounds = q._brackets, []

    def off(own, n_values, probs, margin):
        rounds.append(margin)
        if margin < 0.1:
            return right(own, n_values, [0.9] * len(probs), margin)
        return right(own, n_values, probs, margin)

    monkeypatch.setattr(q, "_brackets", off)
    values = np.random.default_rng(3).normal(size=4000)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "x double, g int")
    got = {r.g: r for r in q.exact_quantiles(df, ["x"], [0.25, 0.9], ["g"]).collect()}
    assert rounds == [0.001, 0.01, 0.1]
    for g in (0, 1):
        assert np.allclose([got[g].q0, got[g].q1], np.quantile(values[g::2], [0.25, 0.9]))


def test_few_values_are_shuffled(spark):
    """The second pass hands on far fewer records than rows times columns."""
    from firegrid.operators import quantiles as q
    own = spark.range(0, 200_000, 1, 8).select(F.struct(F.lit(0)).alias("_by"), *[F.rand(i).alias(f"_v{i}") for i in range(3)])
    b = q._brackets(own, 3, [0.5], q.MARGIN)
    assert q._counted(own, b, 3, [0.5], False).count() < 0.01 * 3 * 200_000
