"""Exact evaluation of scores against 0/1 labels, per group if asked.

Rows are first counted per distinct score. All curve points and areas then follow from
running totals over the scores; the point before a given one is the running total
without the row's own counts, so no lag over a global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.ordering import running_total
from firegrid.session import written


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def score_counts(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """(by, threshold, pos, cnt): positives and rows at each distinct score; such a table itself is only added up."""
    if {"threshold", "pos", "cnt"} <= set(df.columns):
        return df.groupBy(*(by or []), "threshold").agg(F.sum("pos").alias("pos"), F.sum("cnt").alias("cnt"))
    return df.groupBy(*(by or []), F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))


def running_counts(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """Counts at and above each distinct score, with the group totals ``all_pos``, ``all_neg``."""
    by = list(by or [])
    counts = score_counts(df, by, label, score)
    cum = running_total(counts, by, "threshold", ["pos", "cnt"], descending=True)
    sums = counts.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"), (F.sum("cnt") - F.sum("pos")).alias("all_neg"))
    if by:
        return cum.join(sums, by)
    return cum.withColumns({c: sums.select(c).scalar() for c in ("all_pos", "all_neg")})


def _pr(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "precision": _ratio(F.col("cum_pos"), F.col("cum_cnt")),
        "recall": _ratio(F.col("cum_pos"), F.col("all_pos"), 1.0)})


def _endpoint(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """One closing point per group, also for an ungrouped curve."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return groups.select(*by, *[v.alias(k) for k, v in values.items()])


def pr_curve(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (NULL, 1, 0)."""
    by = list(by or [])
    points = _pr(running_counts(df, by, label, score)).select(*by, "threshold", "precision", "recall")
    return points.unionByName(_endpoint(df, by, {
        "threshold": F.lit(None).cast("double"), "precision": F.lit(1.0), "recall": F.lit(0.0)}))


def best_threshold(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """Threshold of largest F1 (ties: the smallest); 0.5 without any score."""
    by = list(by or [])
    p = _pr(running_counts(df, by, label, score))
    f1 = 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    return p.withColumn("f1", f1).groupBy(*by).agg(
        F.coalesce(F.max_by("threshold", F.struct("f1", -F.col("threshold"))), F.lit(0.5)).alias("threshold"),
        F.max("f1").alias("f1"))


def roc_curve(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the start point (NULL, 0, 0)."""
    by = list(by or [])
    c = running_counts(df, by, label, score)
    points = c.select(
        *by, "threshold",
        _ratio(F.col("cum_cnt") - F.col("cum_pos"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))
    return points.unionByName(_endpoint(df, by, {
        "threshold": F.lit(None).cast("double"), "fpr": F.lit(0.0), "tpr": F.lit(0.0)}))


def curve_areas(df: DataFrame, by: list[str] | None = None, label="label", score="score") -> DataFrame:
    """``roc_auc`` (ties count half), ``average_precision`` (steps), ``pr_auc`` (trapezoid)."""
    c = _pr(running_counts(df, by, label, score))
    pos, neg = F.col("pos").cast("double"), (F.col("cnt") - F.col("pos")).cast("double")
    above = F.col("cum_pos").cast("double") - pos
    prior = _ratio(F.col("cum_pos") - F.col("pos"), F.col("cum_cnt") - F.col("cnt"), 1.0)
    gain = F.try_divide(pos, F.col("all_pos").cast("double"))
    pairs = F.try_divide(
        neg * (above + pos / 2.0), F.col("all_pos").cast("double") * F.col("all_neg").cast("double"))
    return c.groupBy(*(by or [])).agg(
        F.sum(pairs).alias("roc_auc"),
        F.sum(gain * F.col("precision")).alias("average_precision"),
        F.sum(gain * (F.col("precision") + prior) / 2.0).alias("pr_auc"))


def confusion(
    df: DataFrame, threshold: Column | float, by: list[str] | None = None, label="label", score="score"
) -> DataFrame:
    """tn, fp, fn, tp for ``score >= threshold``; the threshold may depend on the group."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = df.select(*(by or []), (F.col(label) == 1).alias("y"), (F.col(score) >= cut).alias("hit"))
    return rows.groupBy(*(by or [])).agg(
        F.count_if(~F.col("y") & ~F.col("hit")).alias("tn"),
        F.count_if(~F.col("y") & F.col("hit")).alias("fp"),
        F.count_if(F.col("y") & ~F.col("hit")).alias("fn"),
        F.count_if(F.col("y") & F.col("hit")).alias("tp"))


def confusion_nested(counts: DataFrame) -> DataFrame:
    """The 2 x 2 nested form [[tn, fp], [fn, tp]]."""
    return counts.withColumn(
        "confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp"))).drop("tn", "fp", "fn", "tp")


def class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def counted_confusion(counts: DataFrame, cut: Column, by: list[str]) -> DataFrame:
    """tn, fp, fn, tp per group from a table of ``score_counts``."""
    hit, neg = F.col("threshold") >= cut, F.col("cnt") - F.col("pos")
    total = lambda on, c: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    return counts.groupBy(*by).agg(total(~hit, neg).alias("tn"), total(hit, neg).alias("fp"),
                                   total(~hit, F.col("pos")).alias("fn"), total(hit, F.col("pos")).alias("tp"))


POLICIES = ("shared", "standalone", "given", "best")


def split_metrics(
    df: DataFrame, policy: str = "shared", split: str = "split", label="label", score="score", threshold: float | None = None,
) -> DataFrame:
    """All metrics per split, with the nested ``confusion_matrix`` [[tn, fp], [fn, tp]].

    ``shared``: the F1-best test threshold everywhere; ``standalone``: that threshold for the test split, 0.5 for the
    others; ``given``: ``threshold`` everywhere; ``best``: each split's own F1-best threshold.
    Scored rows are read once, into counts per (split, score) that are stored; everything follows from that table.
    Rows without label or score take no part.
    """
    if policy not in POLICIES or (policy == "given") != (threshold is not None):
        raise ValueError(f"unknown policy {policy!r}, or a threshold without the policy 'given'")
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = written(score_counts(known, [split], label, score), "score-counts")
    if policy == "given":
        rows = counts.withColumn("_cut", F.lit(float(threshold)))
    elif policy == "best":
        own = best_threshold(counts, [split]).select(F.col(split).alias("_split"), F.col("threshold").alias("_cut"))
        rows = counts.join(own, F.col(split).eqNullSafe(F.col("_split"))).drop("_split")
    else:
        best = best_threshold(counts.where(F.col(split) == "test")).select("threshold").scalar()
        rows = counts.withColumn("_cut", F.coalesce(best, F.lit(0.5)))
        if policy == "standalone":
            rows = rows.withColumn("_cut", F.when(F.col(split) == "test", F.col("_cut")).otherwise(0.5))
    matrix = counted_confusion(rows, F.col("_cut"), [split, "_cut"])
    nested = matrix.withColumn("confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))
    areas = curve_areas(counts, [split]).withColumnRenamed(split, "_split")
    return class_metrics(nested).withColumnRenamed("_cut", "threshold_used").join(
        areas, F.col(split).eqNullSafe(F.col("_split"))).drop("_split")


def overfit_gaps(
    df: DataFrame, policy: str = "shared", split: str = "split", label="label", score="score", threshold: float | None = None,
) -> DataFrame:
    """One row: test, train and validation metrics, the nested matrix of the test split, and the differences."""
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]
    m = split_metrics(df, policy, split, label, score, threshold)

    def of(part: str, c: str) -> Column:
        return F.max(F.when(F.col(split) == part, F.col(c)))

    wide = m.agg(
        *[of(p, c).alias(f"{pre}{c}") for p, pre in (("test", ""), ("train", "train_"), ("val", "val_"))
          for c in names],
        of("test", "threshold_used").alias("threshold_used"), of("test", "confusion_matrix").alias("confusion_matrix"))
    return wide.withColumns({
        "train_test_accuracy_gap": F.col("train_accuracy") - F.col("accuracy"),
        "train_test_roc_auc_gap": F.col("train_roc_auc") - F.col("roc_auc"),
        "train_val_accuracy_gap": F.col("train_accuracy") - F.col("val_accuracy"),
        "val_test_accuracy_gap": F.col("val_accuracy") - F.col("accuracy")})


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted averages from one row of confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(hit, false_hit, missed):
        return (_ratio(hit, hit + false_hit), _ratio(hit, hit + missed),
                _ratio(2 * hit, 2 * hit + false_hit + missed), (hit + missed).cast("long"))

    zero, one = line(tn, fn, fp), line(tp, fp, fn)
    total = tn + fp + fn + tp
    acc = _ratio(tn + tp, total)
    macro = [(a + b) / 2.0 for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    rows = {"0": zero, "1": one, "accuracy": (acc, acc, acc, total),
            "macro avg": (*macro, total), "weighted avg": (*weighted, total)}
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"),
                 f.alias("f1"), s.cast("long").alias("support"))
        for k, (p, r, f, s) in rows.items()])))


def model_comparison(df: DataFrame, model: str = "model", label="label", score="score") -> DataFrame:
    """ROC area and trapezoid area under precision over recall, per model."""
    return curve_areas(df, [model], label, score).select(
        model, "roc_auc", F.col("pr_auc").alias("average_precision"))
