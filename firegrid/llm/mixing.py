"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size (words). A source's target is a whole number of epochs plus a rest. The rest is
fitted in three steps over the size counts: the same share of every size, then the largest sizes that still
fit while the remainder is above ``WINDOW`` words, then bounded-knapsack dynamic programming over the remainder, which
finds the reachable sum nearest below or at it. Within a size the documents are picked by seeded hash.

Defined cases: null text and text without words have size 0, are always taken a whole number of epochs, and
add nothing. The null source is a source of its own, after all others. Repeated rows are documents of their own. If all sizes are 0 all
targets are 0. An empty table gives no rows.

Scale: only (source, size) counts meet in a task, one source at a time, and their number is bounded by the longest
text. The pick never sorts a (source, size) group in one task: it cuts the hash range into
buckets of about ``BUCKET`` documents, sums whole buckets, and ranks only inside buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import n_words
from firegrid.session import written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
WINDOW, BUCKET, SEED = 1 << 16, 1000, 17


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words for each source; those above ``most`` times their size are cut, and the excess is reshared by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size add up to the largest sum up to ``budget``; sizes are positive and distinct."""
    reach = np.full(budget + 1, -1, np.int32)  # the size that first reached a sum
    reach[0] = 0
    step = np.zeros(budget + 1, np.int32)  # copies of it used then
    chosen = np.zeros(len(sizes), np.int64)
    for i in np.argsort(sizes):
        l, c = int(sizes[i]), int(counts[i])
        if l > budget or reach[budget] >= 0:
            break
        for t in range(1, min(c, budget // l) + 1):
            new = np.flatnonzero((reach[l:] < 0) & (reach[:-l] >= 0) & ((reach[:-l] != i + 1) | (step[:-l] == t - 1))) + l
            new = new[(reach[new - l] != i + 1) if t == 1 else (reach[new - l] == i + 1)]
            if not len(new):
                break
            reach[new], step[new] = i + 1, t
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i = reach[at] - 1
        chosen[i] += step[at]
        at -= int(sizes[i]) * int(step[at])
    return chosen


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size make up ``budget`` words as nearly as the three steps can."""
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return taken
    taken = np.array([int(c) * min(budget, total) // total for c in counts], dtype=np.int64)
    taken[sizes == 0] = 0
    left = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= window:
            break
        if sizes[i]:
            more = min(int(counts[i] - taken[i]), (left - window // 2) // int(sizes[i]))
            taken[i] += max(0, more)
            left -= max(0, more) * int(sizes[i])
    free = np.flatnonzero((sizes > 0) & (counts > taken))
    if 0 < left and len(free):
        taken[free] += knapsack(sizes[free], (counts - taken)[free], min(left, 2 * window))
    return taken


def plan(counts: DataFrame, goal: dict) -> DataFrame:
    """source, size, epochs, extra (documents that are taken once more) from (source, size, n)."""
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        source = None if pd.isna(key[0]) else key[0]
        pdf = pdf.sort_values("size")
        total = int((pdf["size"] * pdf["n"]).sum())
        budget = int(np.floor(goal[source] + 0.5))
        epochs = budget // total if total else 1
        if epochs * total == budget:
            extra = np.zeros(len(pdf), np.int64)
        else:
            extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget - epochs * total)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": total, "target": float(goal[source]),
                             "epochs": epochs, "extra": extra})
    return counts.groupBy("source").applyInPandas(
        one, "source string, size long, n long, source_size long, target double, epochs long, extra long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0, 1, 2, ...: how often the mix takes it) for each row of ``docs``."""
    rows = written(docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size")), "sizes")
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = {r["source"]: int(r["s"]) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    planned = plan(counts, targets(sums, weights, share, most))
    planned = planned.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long"))
    return _pick(rows, planned, seed).withColumnRenamed("id", "doc_id")


def _pick(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    hashed = F.xxhash64(F.lit(seed), "id")
    joined = rows.join(planned.withColumnsRenamed({"source": "p_source", "size": "p_size"}),
                       F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "inner")
    joined = joined.withColumn("hash", hashed).withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 20), F.col("buckets")))
    key = ["source", "size", "bucket"]
    totals = joined.groupBy(*key).agg(F.count(F.lit(1)).alias("b"), F.first("extra").alias("extra"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "size", "bucket", (F.col("extra") - F.coalesce(F.sum("b").over(before), F.lit(0))).alias("quota"))
    totals = totals.withColumnsRenamed({k: "t_" + k for k in key})
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "id"))
    ranked = joined.withColumn("rank", rank)
    out = ranked.join(totals, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")) & (F.col("bucket") == F.col("t_bucket")), "inner")
    copies = F.col("epochs") + (F.col("rank") <= F.col("quota")).cast("long")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``documents``."""
    return mix_sources(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def expand(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the same columns.

    The picks are made on ids and sizes alone, so texts are shuffled once, to meet their picks.
    """
    picks = mix_sources(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    rows = rows.join(picks, rows["id"].eqNullSafe(picks["doc_id"]), "inner")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row.source", "row.text"))
    rows = rows.withColumn("times", F.element_at("copies", nth)).where("times > 0")
    return rows.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).select("row.*")
