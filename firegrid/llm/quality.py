"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

Shallow trees grown on the labelled rows give paths from the root; every path is a conjunction of at most ``DEPTH`` threshold
tests. A logistic regression with an L1 penalty weighs the rules and most weights become 0. What is left is one Spark
column: sigmoid(bias + sum of weights of the rules that hold).

Defined cases: null texts count as empty, all shares of an empty text are 0, and it gets a score like any other. Labels
other than 0 and 1 and null ids are not learned from; several labels of one id count each. Without labels of both
classes the score is the share of label 1 (0.5 without labels). Repeated rows give repeated results.

Scale: statistics are built-in functions inside the scan, and scoring has no shuffle. Labels meet statistics, never texts, so
that the learner's join moves some numbers a row. Learning reads all labelled rows through Spark's own distributed trees and
regression; only the rules come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import fold, let
from firegrid.session import written

TREES, DEPTH, BINS, PENALTY, SEED, THRESHOLD = 12, 3, 32, 0.002, 7, 0.3


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a whole text; shares are of its symbols, words or lines."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    n_words = F.greatest(count(r"[^\x20\x09-\x0D]+"), F.lit(1))
    lines = F.split(t, "\n")
    return {
        "words": F.log1p(n_words.cast("double")), "word_length": F.length(t) / n_words,
        "bars": without("|"), "symbols": without("#$%&*@~^=_<>{}[]\\"), "shouts": without("!?"), "stops": without(".,;:"),
        "digits": without("0123456789"), "capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "line_length": F.log1p((n / F.size(lines)).cast("double")), "own_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


Rule = tuple[tuple[str, str, float], ...]


def holds(rule: Rule, of=F.col) -> Column:
    """Whether all tests of the rule hold; ``of`` gives the column of a statistic."""
    out = None
    for name, op, at in rule:
        c = of(name) <= at if op == "<=" else of(name) > at
        out = c if out is None else out & c
    return out


@dataclass
class Rules:
    bias: float
    weights: dict[Rule, float]

    def score(self, of=F.col) -> Column:
        """P(label 1) from the statistics columns."""
        total = F.lit(self.bias)
        for rule, w in self.weights.items():
            total = total + F.when(holds(rule, of), w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    out = [path] if path else []
    if node.subtreeDepth() and len(path) < DEPTH:
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        for child, op in ((node.leftChild(), "<="), (node.rightChild(), ">")):
            out += _paths(child, names, (*path, (name, op, at)))
    return out


def learn(table: DataFrame, names: list[str]) -> Rules:
    """Fit on a table of statistics with a column ``label`` (0.0 or 1.0)."""
    share = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    if len(share) < 2:
        p = max(min(share.get(1.0, 0) / sum(share.values()), 1 - 1e-6), 1e-6) if share else 0.5
        return Rules(math.log(p / (1 - p)), {})
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(table).select("x", "label", *names)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED,
                                    featureSubsetStrategy="onethird", maxMemoryInMB=64).fit(rows)
    rules = list(dict.fromkeys(r for t in forest.trees for r in _paths(t._call_java("rootNode"), names)))
    flags = rows.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="f").transform(flags)
    lasso = LogisticRegression(featuresCol="f", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(flags)
    return Rules(float(lasso.intercept), {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w})


def train(docs: DataFrame, labels: DataFrame) -> Rules:
    """Learn ``quality`` from the labelled rows of ``docs``."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    stats = statistics()
    table = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in stats.items())).join(known, "doc_id")
    return learn(written(table.select("label", *stats), "quality-statistics"), list(stats))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """row (all columns of ``docs``) and score; nothing can clash with a column of ``docs``."""
    stats = statistics()
    used = {n for r in rules.weights for n, _, _ in r}
    table = docs.select(F.struct(*docs.columns).alias("row"), *(s.cast("double").alias(k) for k, s in stats.items() if k in used))
    return table.select("row", rules.score().alias("score"))


def learned_fold(docs: DataFrame, labels: DataFrame) -> Rules:
    """Learn from labels of rows whose crc32(doc_id) mod 5 is not 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return train(own.where(fold("doc_id", 5) != 0), known.where(fold("doc_id", 5) != 0))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``documents``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(own, learned_fold(docs, labels))
    return scored.select("row.doc_id", "score").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                                                       F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the same columns.

    The statistics are bound once: a filter on a projected score would be pushed below it and repeat them for every rule test.
    """
    rules = learned_fold(docs, labels)
    used = {n for r in rules.weights for n, _, _ in r}
    stats = F.struct(*(c.cast("double").alias(k) for k, c in statistics().items() if k in used), F.lit(0).alias("_none"))
    return docs.where(let(stats, lambda s: rules.score(lambda name: s[name])) >= THRESHOLD)
