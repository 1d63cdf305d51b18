import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import evaluation as e


def data(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(np.round(0.3 * y + 0.5 * rng.random(n), 2), 0, 1)
    p[rng.random(n) < 0.33] = 0.4  # one score holds a third of the rows
    return y, p


@pytest.fixture(scope="module")
def scores(spark):
    y, p = data()
    rows = [(int(a), float(b), "ab"[i % 2], ("train", "val", "test")[i % 3]) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "label int, score double, model string, split string").cache()


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def pr(y, p):
    out = []
    for t in sorted(set(p)):
        hit = p >= t
        out.append((t, y[hit].mean(), y[hit].sum() / y.sum()))
    return out


def test_pr_curve_and_threshold(scores):
    y, p = data()
    want = pr(y, p)
    got = sorted((r for r in e.pr_curve(scores).collect() if r.threshold is not None), key=lambda r: r.threshold)
    assert np.allclose([(r.threshold, r.precision, r.recall) for r in got], want)
    assert [(r.precision, r.recall) for r in e.pr_curve(scores).where("threshold IS NULL").collect()] == [(1.0, 0.0)]
    f1 = [2 * a * b / (a + b + 1e-8) for _, a, b in want]
    best = e.best_threshold(scores).first()
    assert best.threshold == want[int(np.argmax(f1))][0] and best.f1 == pytest.approx(max(f1))


def test_areas_per_group(scores):
    y, p = data()
    got = {r.model: r for r in e.curve_areas(scores, ["model"]).collect()}
    for k, m in enumerate("ab"):
        yy, pp = y[k::2], p[k::2]
        assert got[m].roc_auc == pytest.approx(auc(yy, pp))
        pts = [(1.0, 0.0)] + [(a, b) for _, a, b in reversed(pr(yy, pp))]
        steps = [(b1 - b0, a0, a1) for (a0, b0), (a1, b1) in zip(pts, pts[1:])]
        assert got[m].average_precision == pytest.approx(sum(d * a1 for d, _, a1 in steps))
        assert got[m].pr_auc == pytest.approx(sum(d * (a0 + a1) / 2 for d, a0, a1 in steps))
    both = {r.model: r.average_precision for r in e.model_comparison(scores).collect()}
    assert both["a"] == pytest.approx(got["a"].pr_auc)


def test_roc_curve_area_matches(scores):
    pts = sorted((r.fpr, r.tpr) for r in e.roc_curve(scores).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(auc(*data())) and pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_confusion_metrics_report(scores):
    y, p = data()
    counts = e.confusion(scores, 0.5)
    m = e.class_metrics(counts).first()
    hit = p >= 0.5
    assert (m.tn, m.fp, m.fn, m.tp) == tuple(int(x) for x in (
        (~hit & (y == 0)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (hit & (y == 1)).sum()))
    assert m.accuracy == pytest.approx((hit == y).mean()) and m.f1 == pytest.approx(2 * m.tp / (2 * m.tp + m.fp + m.fn))
    assert e.confusion_nested(counts).first().confusion_matrix == [[m.tn, m.fp], [m.fn, m.tp]]
    rep = {r["class"]: r for r in e.classification_report(counts).collect()}
    assert rep["1"].precision == pytest.approx(m.precision) and rep["0"].support == (y == 0).sum()
    assert rep["weighted avg"].recall == pytest.approx(m.accuracy)
    none = e.class_metrics(e.confusion(scores, 2.0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_policies(scores):
    shared = {r.split: r.threshold_used for r in e.split_metrics(scores).collect()}
    alone = {r.split: r.threshold_used for r in e.split_metrics(scores, "standalone").collect()}
    assert len(set(shared.values())) == 1 and alone["train"] == alone["val"] == 0.5 and alone["test"] == shared["test"]
    g = e.overfit_gaps(scores).first()
    assert g.train_test_accuracy_gap == pytest.approx(g.train_accuracy - g.accuracy)
    with pytest.raises(ValueError):
        e.overfit_gaps(scores, "other")


def test_one_class_only(scores):
    m = e.curve_areas(scores.where("label = 0")).first()
    assert m.roc_auc is None or m.roc_auc == 0.0
    assert e.best_threshold(scores.where(F.lit(False))).first().threshold == 0.5
