import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import modelling as m
from firegrid.plans.training import train_and_evaluate

SMALL = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3, "max_bin": 32, "min_child_weight": 1, "subsample": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    a, b = rng.random(600), rng.random(600)
    y = (a + 0.1 * rng.random(600) > 0.6).astype(int)
    data = [(i, float(a[i]), float(b[i]), int(y[i])) for i in range(600)]
    return spark.createDataFrame(data, "id int, a double, b double, label int").cache()


@pytest.fixture(scope="module")
def model(rows):
    return m.train(rows, ["a", "b"], params=SMALL)


def test_score_and_roundtrip(spark, rows, model, tmp_path):
    scored = m.score(rows, model)
    assert scored.where("fire_predicted = label").count() > 540
    assert scored.where("fire_probability NOT BETWEEN 0 AND 1").count() == 0
    m.save_model(model, str(tmp_path / "m"))
    again = m.score(rows, m.load_model(str(tmp_path / "m")))
    assert scored.select("id", "fire_probability").exceptAll(again.select("id", "fire_probability")).count() == 0
    s = m.score_summary(scored).first()
    assert s.total_rows == 600 and 0 < s.predicted_fires < 600
    with pytest.raises(ValueError, match="missing feature"):
        m.score(rows.drop("a"), model)


def test_importances(spark, rows, model):
    top = m.feature_importance(model, spark, 1).first()
    assert top.feature == "a"
    perm = {r.feature: r for r in m.permutation_importance(rows, model, "id", repeats=3).collect()}
    assert perm["a"].importance > 0.2 > abs(perm["b"].importance) and perm["a"].std >= 0


def test_cross_validation(rows):
    cv = m.cv_auc(rows, ["a", "b"], "id", folds=3, params=SMALL)
    got = cv.collect()
    assert sorted(r.fold for r in got) == [0, 1, 2] and all(r.roc_auc > 0.9 and abs(r.rows - 200) <= 1 and 1 <= r.n_trees <= 5 for r in got)
    assert sum(r.positives for r in got) == rows.where("label = 1").count()
    mean = m.cv_summary(cv).first()
    areas = [r.roc_auc for r in got]
    assert mean["mean"] == pytest.approx(np.mean(areas)) and mean["std"] == pytest.approx(np.std(areas)) and mean.folds == 3


def test_folds_of_large_tables_are_fitted_one_by_one(rows, monkeypatch):
    """Fits at one time share the executors' memory; the models do not depend on how many there are."""
    running, most, fit = [], [], m.fit_early

    def counted(*args):
        running.append(1)
        most.append(len(running))
        try:
            return fit(*args)
        finally:
            running.pop()

    monkeypatch.setattr(m, "fit_early", counted)
    areas = []
    for at_once in (10_000, 600):
        monkeypatch.setattr(m, "PARALLEL_ROWS", at_once, raising=False)
        most.clear()
        areas.append({(r.fold, r.roc_auc, r.n_trees) for r in m.cv_auc(rows, ["a", "b"], "id", folds=3, params=SMALL).collect()})
    assert max(most) == 1 and areas[0] == areas[1]


def test_best_prefix():
    assert m.best_prefix([3.0, 2.0, 2.5, 2.0, 2.0], 3) == (2, True)
    assert m.best_prefix([3.0, 2.0, 2.5, 1.0, 2.0], 3) == (4, False)
    assert m.best_prefix([3.0, 2.0, 4.0, 4.0, 4.0, 0.0], 3) == (2, True)  # a later gain comes too late
    assert m.best_prefix([1.0], 3) == (1, False)


def test_early_stopping_doubles_until_the_loss_stops(spark, rows):
    """The cut model equals a plain fit of as many trees, and its loss is the least of a long fit up to the stop."""
    noisy = rows.withColumn("label", F.when(F.crc32(F.col("id").cast("string")) % 4 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    data, _ = m.vectors(noisy, ["a", "b"])
    data = data.select("label", "class_weight", "features", (F.col("id") % 3 == 0).alias("v")).cache()
    learn, hold = data.where("NOT v"), data.where("v")
    params = {**SMALL, "n_estimators": 24}
    model = m.fit_early(learn, hold, params, rounds=5, first=6)
    losses = m.learner(params, "label", "class_weight").fit(learn).evaluateEachIteration(hold)
    n, _ = m.best_prefix(losses, 5)
    assert model.getNumTrees == n and model.evaluateEachIteration(hold) == losses[:n]
    plain = m.learner({**params, "n_estimators": n}, "label", "class_weight").fit(learn)
    same = model.transform(hold).select("probability").exceptAll(plain.transform(hold).select("probability"))
    assert same.count() == 0


def test_permutation_is_a_bijection(rows):
    for n in (1, 2, 7, 600, 30030):
        for r in range(10):
            a, b = m._step(n, r)
            assert len({(a * i + b) % n for i in range(n)}) == n
    flip = m.permutation_importance(rows, lambda d: d.withColumn("fire_predicted", (F.col("a") > 0.5).cast("int")), "id", features=["a", "b"])
    got = {r.feature: r for r in flip.collect()}
    assert got["b"].importance == 0.0 == got["b"]["std"] and got["a"].importance > 0.3


def test_class_weight(rows):
    w = m.with_class_weight(rows).groupBy("label").agg(F.sum("class_weight").alias("w")).collect()
    assert w[0].w == pytest.approx(w[1].w)


def test_parameters():
    with pytest.warns(UserWarning, match="reg_alpha"):
        g = m.learner({"reg_alpha": 1.0})
    assert (g.getMaxIter(), g.getStepSize(), g.getFeatureSubsetStrategy(), g.getMaxBins()) == (500, 0.01, "0.7", 256)


def test_flow(rows):
    _, scored, metrics = train_and_evaluate(rows.withColumnRenamed("label", "fire"), ["a", "b", "zzz"], "id", params=SMALL)
    assert scored.count() == 600
    r = metrics.first()
    assert r.roc_auc > 0.9 and abs(r.train_test_accuracy_gap) < 0.2
