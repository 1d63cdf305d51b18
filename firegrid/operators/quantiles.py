"""Exact interpolated quantiles for groups of any size, by bracket selection.

1. One pass builds, per group and column, the row count and a mergeable sketch. It gives for each wanted
   rank a bracket of two values that should hold it.
2. A second pass counts, map-side, the rows below each bracket, and the values inside it. Only those counts are
   shuffled: a row outside every bracket costs nothing.
3. Brackets that missed their rank, by the exact counts, are widened and counted again; the widest hold everything.
4. The few values left are ranked. They are cut into ranges of about equal count, and only the wanted range of a
   bracket is sorted, each in its own task.

The sketch only chooses the brackets: the result is exact for any sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators.ordering import bisect, cut_points
from firegrid.session import written

STEPS = 8
ACCURACY, MARGIN = 2000, 0.001  # a sketch misses a rank by at most 1 / ACCURACY of the rows


def to_long(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, variable, x) with one row per non-NULL value."""
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values]
    return df.select(*by, F.inline(F.array(*pairs))).where(F.col("x").isNotNull())


def _brackets(own: DataFrame, n_values: int, probs: list[float], margin: float) -> DataFrame:
    """(_by, n0 .., s0 ..): rows, and lower and upper bound of each probability, of each group and column."""
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = [F.percentile_approx(f"_v{i}", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias(f"s{i}") for i in range(n_values)]
    return own.groupBy("_by").agg(*[F.count(f"_v{i}").alias(f"n{i}") for i in range(n_values)], *sketch)


def _counted(own: DataFrame, brackets: DataFrame, n_values: int, probs: list[float], everything: bool) -> DataFrame:
    """(_by, i, k, x, c): rows with value x inside bracket k of column i; x is NULL for all rows below it."""
    entries = []
    for i in range(n_values):
        for k in range(len(probs)):
            x, low, high = F.col(f"_v{i}"), F.col(f"s{i}")[2 * k], F.col(f"s{i}")[2 * k + 1]
            entry = F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), x.alias("x") if everything else F.when(x >= low, x).alias("x"))
            entries.append(F.when(x.isNotNull() if everything else x <= high, entry))
    joined = own.join(brackets, "_by")
    rows = joined.select("_by", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("_by", "e.*")
    return rows.groupBy("_by", "i", "k", "x").agg(F.count(F.lit(1)).alias("c"))


def _placed(counts: DataFrame, brackets: DataFrame, n_values: int, probs: list[float]) -> DataFrame:
    """(_by, i, k, n, below, lo, hi, inside): the two wanted ranks inside each bracket, counted from its first row."""
    size = F.element_at(F.array(*[F.col(f"n{i}") for i in range(n_values)]), F.col("i") + 1)
    sums = counts.groupBy("_by", "i", "k").agg(
        F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("c"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("c"))), F.lit(0)).alias("inside"))
    pos = F.element_at(F.array(*map(F.lit, probs)), F.col("k") + 1) * (F.col("n") - 1)
    return sums.join(brackets.select("_by", *[f"n{i}" for i in range(n_values)]), "_by").withColumn("n", size).select(
        "_by", "i", "k", "n", "inside", (pos - F.floor(pos)).alias("part"),
        (F.floor(pos) - F.col("below")).alias("lo"), (F.ceil(pos) - F.col("below")).alias("hi"))


def exact_quantiles(
    df: DataFrame, values: list[str], probs: list[float], by: list[str] | None = None,
    steps: int = STEPS, margin: float = MARGIN,
) -> DataFrame:
    """One row per (by, variable): ``n`` and ``q0 .. qk``, linear interpolation.

    Groups may be of any number and size; NULL in ``by`` is a group like any other, and a column without values in a
    group gives no row.
    """
    by = list(by or [])
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))  # a struct is never NULL, so no join loses a group
    own = df.select(key.alias("_by"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    found = None
    todo = own
    while True:
        everything = margin >= 1.0
        brackets = written(_brackets(todo, len(values), probs, margin), "brackets")
        counts = written(_counted(todo, brackets, len(values), probs, everything), "bracket-counts")
        ranks = written(_placed(counts, brackets, len(values), probs), "bracket-ranks")
        missed = ranks.where("lo < 0 OR hi >= inside").select("_by").distinct()
        again = not everything and not missed.isEmpty()
        hit = counts.where("x IS NOT NULL").join(ranks.drop("inside"), ["_by", "i", "k"])
        if again:  # a group with a missed rank is left to the next round as a whole
            hit = hit.join(missed, "_by", "left_anti")
        found = hit if found is None else found.unionByName(hit)
        if not again:
            break
        todo, margin = own.join(missed, "_by", "left_semi"), margin * 10
    keys = ["_by", "i", "k"]
    bounds = found.groupBy(*keys).agg(F.percentile_approx("x", cut_points(steps), F.lit(10000)).alias("_bounds"))
    ranged = bisect(found.join(bounds, keys), "x", steps)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_bucket").agg(F.sum("c").alias("t"), F.first("lo").alias("l"), F.first("hi").alias("h")).withColumn(
        "before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    wanted = totals.where("before <= h AND l < before + t").select(*keys, "_bucket", "before")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(wanted, [*keys, "_bucket"]).withColumn("end", F.col("before") + F.sum("c").over(inside))
    at = lambda rank: F.min(F.when(F.col("end") > F.col(rank), F.col("x")))
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max("part").alias("part"), at("lo").alias("a"), at("hi").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    wide = picked.groupBy("_by", "i").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("k") == k, value)).alias(f"q{k}") for k in range(len(probs))])
    names = F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    return wide.select(*[F.col(f"_by.{b}").alias(b) for b in by], names.alias("variable"), "n", *[f"q{k}" for k in range(len(probs))])


def quantiles_wide(
    df: DataFrame, values: list[str], probs: list[float], by: list[str] | None = None,
) -> DataFrame:
    """One row per ``by`` with ``<value>_q0 ..``."""
    by = list(by or [])
    q = exact_quantiles(df, values, probs, by)
    cols = [
        F.max(F.when(F.col("variable") == v, F.col(f"q{k}"))).alias(f"{v}_q{k}")
        for v in values for k in range(len(probs))
    ]
    return q.groupBy(*by).agg(*cols)
