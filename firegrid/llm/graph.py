"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined map-side) and a join; edges are written between rounds, so lineage is
cut at durable tables and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.session import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: the least node of its component, for each node of ``edges`` (a, b; longs)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select("v", "v").distinct().toDF("node", "label"))
        before = tuple(seen)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v"), F.col("m")).union(least.select(F.col("u"), F.col("m"))).where("v <> m")
        now = written(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct(), "edges")
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
