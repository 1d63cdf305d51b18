"""Global order without a one-task sort.

A running total or a rank over a whole table needs one total order. Rows are put into
buckets that respect this order, the few bucket totals are summed up first, and each
bucket is then sorted by a task of its own. A group holding most of the rows is thereby
split over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 10  # 2**10 = 1024 equal-count buckets


def cut_points(steps: int) -> Column:
    """The probabilities that cut a distribution into ``2**steps`` parts."""
    n = 2**steps
    return F.expr("array(" + ", ".join(f"{i / n!r}D" for i in range(1, n)) + ")")


def bisect(rows: DataFrame, value: str, steps: int) -> DataFrame:
    """Replace ``_bounds`` (``2**steps - 1`` sorted values) by ``_bucket``, the number of bounds <= value.

    One projection per step: all of them stay in one codegen stage.
    """
    rows = rows.withColumn("_bucket", F.lit(0))
    for k in reversed(range(steps)):
        bound = F.get("_bounds", F.col("_bucket") + (2**k - 1))
        step = F.when(bound <= F.col(value), F.lit(2**k)).otherwise(F.lit(0))
        rows = rows.withColumn("_bucket", F.col("_bucket") + step)
    return rows.drop("_bounds")


def with_bucket(df: DataFrame, value: str, steps: int = STEPS) -> DataFrame:
    """Add ``_bucket``: approximate quantiles of ``value`` cut the table into equal counts.

    The bounds are a scalar subquery. They only balance the buckets: results built on
    them are exact for any bounds.
    """
    sketch = df.agg(F.percentile_approx(value, cut_points(steps), F.lit(10000))).scalar()
    return bisect(df.withColumn("_bounds", sketch), value, steps)


def _grouped(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Add ``_by``, a struct of the group's columns: it is never NULL, so joins keep NULL groups."""
    return (rows.withColumn("_by", F.struct(*by)), ["_by"]) if by else (rows, [])


def running_total(
    df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<name>``: the sum of each column up to and including the row's value.

    ``df`` must hold one row per (by, value); NULL in ``by`` is a group like any other.
    """
    rows, group = _grouped(with_bucket(df, value), by)
    if descending:
        rows = rows.withColumn("_bucket", -F.col("_bucket"))
    keys = [*group, "_bucket"]
    totals = rows.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(s).over(inside).alias(f"_c_{s}") for s in sums])
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums]
    )


def seeded_hash(key: Column | str, seed) -> Column:
    """md5 of ``key|seed``: the same order in every engine and on every retry."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def _prefix_offsets(rows: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    keys = [*by, "_prefix"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    cols = [*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")]
    if size:
        cols.append(F.sum("_n").over(Window.partitionBy(*by)).alias(size))
    return counts.select(*cols)


def hash_rank(
    df: DataFrame, by: list[str], key: Column | str, seed, out: str = "hash_rank",
    size: str | None = None, digits: int = 3, below: Column | None = None,
) -> DataFrame:
    """0-based rank inside ``by`` in the order of the seeded hash of a unique key.

    The first hex digits of the hash make ``16**digits`` even buckets per group. With
    ``below`` only rows ranked under that bound are kept, and buckets past it are
    dropped before the sort. ``size`` also adds the row count of the group.
    """
    rows, group = _grouped(df.withColumn("_hash", seeded_hash(key, seed)), by)
    rows = rows.withColumn("_prefix", F.substring("_hash", 1, digits))
    keys = [*group, "_prefix"]
    # One row per group and prefix; Spark chooses the join side from its measured size.
    offsets = _prefix_offsets(rows, group, size)
    if below is not None:
        offsets = offsets.where(F.col("_before") < below)
    placed = rows.join(offsets, keys)
    inside = Window.partitionBy(*keys).orderBy("_hash")
    ranked = placed.withColumn(
        out, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
    if below is not None:
        ranked = ranked.where(F.col(out) < below)
    return ranked.drop("_hash", "_prefix", "_before", "_by")
