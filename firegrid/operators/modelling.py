"""Gradient-boosted trees on Spark ML: train, cross-validate, score, explain.

Early stopping: trees of a boosted model do not depend on how many follow, so a fit of n trees holds every shorter one.
The loss of each prefix on the validation rows comes from one pass over them; the fit is doubled until the loss has not
gained for ``rounds`` trees, and cut at its best prefix.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from math import gcd

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.evaluation import curve_areas
from firegrid.operators.ordering import hash_rank
from firegrid.operators.sampling import stratified_folds
from firegrid.session import written

# Published settings that Spark's learner also has.
PARAMS = {
    "n_estimators": 500, "max_depth": 5, "learning_rate": 0.01, "subsample": 0.7,
    "colsample_bytree": 0.7, "min_child_weight": 10, "max_bin": 256, "random_state": 42,
}
_NAMES = {
    "n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
    "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode", "max_bin": "maxBins", "random_state": "seed",
}
_HANDLED_ELSEWHERE = {"scale_pos_weight"}
EARLY_STOPPING_ROUNDS, FIRST_TREES, PARALLEL_FOLDS = 20, 40, 5
PARALLEL_ROWS = 20_000_000  # rows of the fits at one time: each fit caches its own rows, and all of them share the executors' memory


def learner(params: dict | None = None, label: str = "label", weight: str | None = None) -> GBTClassifier:
    """GBTClassifier from the published parameter names; those without counterpart warn."""
    given = {**PARAMS, **(params or {})}
    unknown = sorted(set(given) - set(_NAMES) - _HANDLED_ELSEWHERE)
    if unknown:
        warnings.warn(f"no counterpart in Spark's trees, ignored: {unknown}", stacklevel=2)
    args = {_NAMES[k]: v for k, v in given.items() if k in _NAMES and v is not None}
    args["featureSubsetStrategy"] = str(args["featureSubsetStrategy"])
    args["minInstancesPerNode"] = int(args["minInstancesPerNode"])
    if weight:
        args["weightCol"] = weight
    return GBTClassifier(featuresCol="features", labelCol=label, **args)


def with_class_weight(df: DataFrame, label: str = "label", ratio: float | None = None) -> DataFrame:
    """Weight positives by negatives / positives (or a given ratio)."""
    if ratio is None:
        ratio = F.coalesce(df.agg(F.try_divide(
            F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1))).scalar(), F.lit(1.0))
    else:
        ratio = F.lit(float(ratio))
    return df.withColumn("_ratio", ratio).withColumn(
        "class_weight", F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1.0)).drop("_ratio")


def best_prefix(losses: list[float], rounds: int) -> tuple[int, bool]:
    """(trees of the best prefix, whether ``rounds`` trees after it brought no gain) reading losses in order."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= rounds:
            return best + 1, True
    return best + 1, False


def cut(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees."""
    own, context = model._java_obj, SparkContext._active_spark_context
    gateway, jvm = context._gateway, context._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    all_trees, all_weights = own.trees(), own.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    short = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, 2)
    out = model._copyValues(GBTClassificationModel(short))
    out._transfer_params_to_java()
    return out


def fit_early(
    rows: DataFrame, validation: DataFrame, params: dict | None = None, label: str = "label",
    rounds: int = EARLY_STOPPING_ROUNDS, first: int = FIRST_TREES,
) -> GBTClassificationModel:
    """Boost vectors (``features``, ``label``, ``class_weight``) until the validation loss stops falling."""
    most = {**PARAMS, **(params or {})}["n_estimators"]
    n = min(max(first, rounds + 1), most)
    while True:
        model = learner({**(params or {}), "n_estimators": n}, label, "class_weight").fit(rows)
        best, done = best_prefix(model.evaluateEachIteration(validation), rounds)
        if done or n == most:
            return cut(model, best)
        n = min(2 * n, most)


def vectors(df: DataFrame, features: list[str], label: str = "label", params: dict | None = None) -> tuple[DataFrame, VectorAssembler]:
    """``df`` with class weights and the feature vector, and the stage that assembled it."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return assembler.transform(with_class_weight(df, label, (params or {}).get("scale_pos_weight"))), assembler


def _learned(params: dict | None) -> dict:
    return {k: v for k, v in (params or {}).items() if k not in _HANDLED_ELSEWHERE}


def train(
    df: DataFrame, features: list[str], label: str = "label", params: dict | None = None,
    validation: str | None = None, rounds: int = EARLY_STOPPING_ROUNDS,
) -> PipelineModel:
    """Weighted fit; rows flagged by the boolean ``validation`` column are not learned from and stop it early."""
    rows, assembler = vectors(df, features, label, params)
    if not validation:
        return PipelineModel([assembler, learner(_learned(params), label, "class_weight").fit(rows)])
    rows = written(rows.select(label, "class_weight", "features", F.coalesce(F.col(validation), F.lit(False)).alias("_held")), "vectors")
    model = fit_early(rows.where("NOT _held"), rows.where("_held"), _learned(params), label, rounds)
    return PipelineModel([assembler, model])


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score(df: DataFrame, model: PipelineModel, threshold: Column | float = 0.5) -> DataFrame:
    """Add ``fire_probability`` and ``fire_predicted``; missing inputs are an error up front."""
    absent = [c for c in feature_names(model) if c not in df.columns]
    if absent:
        raise ValueError(f"missing feature columns: {absent}")
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    out = model.transform(df).withColumn("fire_probability", vector_to_array("probability")[1])
    return out.withColumn("fire_predicted", (F.col("fire_probability") >= cut).cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction")


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.coalesce(F.sum("fire_predicted"), F.lit(0)).alias("predicted_fires"))


def cv_auc(
    df: DataFrame, features: list[str], key: str, label: str = "label", folds: int = 5,
    params: dict | None = None, seed: int = 42, rounds: int = EARLY_STOPPING_ROUNDS,
) -> DataFrame:
    """(fold, rows, positives, roc_auc, n_trees): one early-stopped model per stratified fold, exact areas for all folds in one query.

    Vectors, weights and folds are stored once; every fit reads that table. As published, a fold also stops its own model.
    Small tables are fitted with all folds at one time, large ones fold by fold; the models are the same.
    """
    parts = stratified_folds(df, key, label, folds, seed)
    rows, _ = vectors(parts, features, label, params)
    rows = written(rows.select("fold", label, "class_weight", "features"), "folds")
    params = _learned(params)

    def one(k: int) -> GBTClassificationModel:
        return fit_early(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), params, label, rounds)

    at_once = min(folds, PARALLEL_FOLDS, max(PARALLEL_ROWS // max(rows.count(), 1), 1))
    with ThreadPoolExecutor(at_once) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds)))
    scored = None
    for k, model in enumerate(models):
        held = model.transform(rows.where(F.col("fold") == k)).select(
            "fold", label, vector_to_array("probability")[1].alias("fire_probability"))
        scored = held if scored is None else scored.unionByName(held)
    scored = written(scored, "fold-scores")
    trees = F.create_map(*[F.lit(x) for k, m in enumerate(models) for x in (k, m.getNumTrees)])
    sizes = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"))
    areas = curve_areas(scored, ["fold"], label, "fire_probability").select("fold", "roc_auc")
    return sizes.join(areas, "fold").withColumn("n_trees", trees[F.col("fold")])


def cv_summary(folds: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the folds' areas, and the rows and positives of all folds."""
    return folds.agg(F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std"), F.count(F.lit(1)).alias("folds"),
                     F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))


def feature_importance(model: PipelineModel, spark, top: int = 20) -> DataFrame:
    """(feature, importance) of the largest ``top``: as many rows as the model has inputs."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(feature_names(model), values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def _step(n: int, repeat: int) -> tuple[int, int]:
    """(a, b) of the bijection rank -> (a * rank + b) mod n; a is coprime to n and near another share of n each time."""
    a = n * ((repeat + 1) * 618033989 % 1000000000) // 1000000000 + 1
    while gcd(a, n) != 1:
        a += 1
    return a, (repeat + 1) * 7919 % n


def permutation_importance(
    df: DataFrame, model: PipelineModel | Callable[[DataFrame], DataFrame], key: str, label: str = "label", repeats: int = 10,
    seed: int = 42, features: list[str] | None = None, predicted: str = "fire_predicted",
) -> DataFrame:
    """Mean and deviation of the accuracy lost when one feature is shuffled.

    Rows are numbered once, in the order of a seeded hash; a repeat is an affine bijection of the numbers, and one integer join
    brings every row the features of its donors of all repeats. ``model`` is a fitted model or any function that adds
    the column ``predicted``.
    """
    if isinstance(model, PipelineModel):
        features, run = features or feature_names(model), lambda d: score(d, model)
    else:
        run = model
    rows = written(hash_rank(df.select(key, label, *features), [], key, seed, "_rank"), "ranks")
    n = rows.count()
    donors = F.array(*[
        F.struct(F.lit(r).alias("_repeat"), ((F.lit(a) * F.col("_rank") + b) % max(n, 1)).cast("long").alias("_donor"))
        for r in range(repeats) for a, b in [_step(max(n, 1), r)]])
    asked = rows.select(key, label, *features, F.inline(donors))
    donor = rows.select(F.col("_rank").alias("_donor"), *[F.col(f).alias(f"_d_{f}") for f in features])
    versions = [
        F.struct(F.lit(f).alias("feature"), *[
            (F.col(f"_d_{g}") if g == f else F.col(g)).alias(g) for g in features])
        for f in features]
    shuffled = asked.join(donor, "_donor").select(key, label, "_repeat", F.inline(F.array(*versions)))

    def hit(d: DataFrame) -> DataFrame:
        return run(d).withColumn("_hit", (F.col(predicted) == F.col(label)).cast("double"))

    full = hit(rows).agg(F.avg("_hit")).scalar()
    lost = hit(shuffled).groupBy("feature", "_repeat").agg(F.avg("_hit").alias("acc"))
    return lost.withColumn("drop", full - F.col("acc")).groupBy("feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
