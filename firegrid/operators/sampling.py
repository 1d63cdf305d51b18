"""Weeks, negative samples, seeded samples, splits and folds.

Every draw is a function of (key, seed), so retries and other engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.functions.calendar import mid_week, week_start, week_text
from firegrid.functions.spatial import with_centre
from firegrid.operators.ordering import hash_rank, seeded_hash
from firegrid.session import written


def all_weeks(df: DataFrame, date: str = "acq_date") -> DataFrame:
    """(week_start, week) from the week of the first to the week of the last day."""
    ends = df.agg(week_start(F.min(date)).alias("a"), week_start(F.max(date)).alias("b"))
    weeks = ends.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    return weeks.withColumn("week", week_text("week_start"))


def hash_number(key: Column, seed) -> Column:
    """60 bits of the seeded hash as a non-negative number."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 15), 16, 10).cast("long")


def negative_samples(
    positives: DataFrame, cells: DataFrame, n: int, seed=42, date: str = "acq_date",
    size_km: float = 1, weeks: tuple | None = None,
) -> DataFrame:
    """``n`` distinct (cell, week) pairs without fire; all of them if there are fewer.

    The pairs are numbered 0 .. cells*weeks-1 but never listed. The numbers are cut into
    n + positives equal strata and one pair is drawn from each: draws are distinct by
    construction, at most one per positive is lost, and exactly n are kept.
    ``positives`` has grid_id, week and ``date``; ``weeks`` is (first Monday, count).
    """
    spark = positives.sparkSession
    # Both key lists are used several times below, so they are computed once and stored.
    known = written(positives.select("grid_id", "week").distinct(), "known")
    cells = written(cells.select("grid_id"), "cells")
    if weeks is None:
        ends = positives.agg(week_start(F.min(date)).alias("a"), week_start(F.max(date)).alias("b")).first()
        weeks = (ends.a, (ends.b - ends.a).days // 7 + 1)
    first, n_weeks = weeks
    total = cells.count() * n_weeks  # only counts reach the driver, to size the range
    strata = min(total, n + known.count())
    if strata == 0:
        strata, base, extra = 0, 1, 0
    else:
        base, extra = divmod(total, strata)
    i = F.col("id")
    pick = (
        i * F.lit(base) + F.least(i, F.lit(extra))
        + hash_number(i, seed) % (F.lit(base) + (i < extra).cast("long")))
    drawn = spark.range(strata).select(pick.alias("pick")).select(
        F.floor(F.col("pick") / n_weeks).alias("cell_no") if total < 2**52
        else F.expr(f"pick div {n_weeks}").alias("cell_no"),
        (F.col("pick") % n_weeks).cast("int").alias("week_no"))
    numbered = hash_rank(cells, [], "grid_id", seed, "cell_no")
    start = F.date_add(F.lit(first).cast("date"), F.col("week_no") * 7)
    pairs = drawn.join(numbered, "cell_no").select("grid_id", start.alias("_start"))
    pairs = pairs.withColumn("week", week_text("_start"))
    free = pairs.join(known, ["grid_id", "week"], "left_anti")
    key = F.concat_ws("|", "grid_id", "week")
    kept = hash_rank(free, [], key, seed, "_rank", below=F.lit(n)).drop("_rank")
    return with_centre(kept, "grid_id", size_km).select(
        "grid_id", "week", "latitude", "longitude", mid_week("_start").alias("acq_date"),
        F.lit(0.0).alias("frp_log"), F.lit(0.0).alias("brightness_normalized"), F.lit(0).alias("fire"))


# Columns of the labelled table.
LABELLED = ["grid_id", "week", "latitude", "longitude", "acq_date", "frp_log", "brightness_normalized"]


def full_dataset(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives (fire = 1) followed by negatives (fire = 0)."""
    pos = positives.select(*LABELLED).withColumn("fire", F.lit(1))
    return pos.unionByName(negatives.select(*LABELLED, "fire"))


def sample_dataset(
    df: DataFrame, total: int | Column, key: Column | str, seed=42, label: str = "fire"
) -> DataFrame:
    """All positives, and negatives up to ``total`` rows in seeded-hash order of a unique key."""
    total = total if isinstance(total, Column) else F.lit(total)
    n_pos = df.where(F.col(label) == 1).agg(F.count(F.lit(1))).scalar()
    room = F.greatest(total - n_pos, F.lit(0))
    negatives = hash_rank(df.where(F.col(label) == 0), [], key, seed, "_rank", below=room)
    return df.where(F.col(label) == 1).unionByName(negatives.drop("_rank"))


def sample_rows(df: DataFrame, n: int | Column, key: Column | str, seed=42) -> DataFrame:
    """``n`` rows in seeded-hash order of a unique key."""
    n = n if isinstance(n, Column) else F.lit(n)
    return hash_rank(df, [], key, seed, "_rank", below=n).drop("_rank")


def stratified_split(
    df: DataFrame, key: Column | str, label: str = "label", test: float = 0.2, val: float = 0.25,
    seed=42,
) -> DataFrame:
    """Add ``part``: per label the first ``test`` share by hash, then ``val`` of the rest, then train."""
    ranked = hash_rank(df, [label], key, seed, "_rank", size="_size")
    share_val = test + val * (1.0 - test)
    part = (
        F.when(F.col("_rank") < F.lit(test) * F.col("_size"), "test")
        .when(F.col("_rank") < F.lit(share_val) * F.col("_size"), "val").otherwise("train"))
    return ranked.withColumn("part", part).select(*df.columns, "part")


def stratified_folds(
    df: DataFrame, key: Column | str, label: str = "label", folds: int = 5, seed=42
) -> DataFrame:
    """Add ``fold`` in 0 .. folds-1, each holding the same share of every label."""
    ranked = hash_rank(df, [label], key, seed, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).select(*df.columns, "fold")
