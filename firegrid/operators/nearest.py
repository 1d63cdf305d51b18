"""Exact nearest point by great-circle distance, as equi-joins on cells of a pyramid.

Level k (2, 4, 6 ..) cuts the globe into cells of 360 / 2**k degrees. Points may carry a bit mask
(the days or months they report in) and queries another; only points that share a bit with the
query count. A cell holds the OR of its points' masks, so one row a cell answers for all days.

1. The finest level at which a query shares its cell with a fitting point bounds the nearest
   distance by r, the diagonal of that cell.
2. The cells that a circle of radius r can touch are listed at the finest level whose cells
   are larger than r: at most three rows of latitude, and few columns.
3. Each of them is split into its occupied cells four levels down (at most 256). Distances to
   their centres tighten the bound, and cells that cannot hold anything nearer go.
4. Only the points of the cells left are compared.

So a query meets a bounded number of cells, and a dense cluster, near or far, is read only
where it faces the query. No search-radius limit is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.spatial import EARTH_KM, haversine_km
from firegrid.session import written

FINEST = 20  # 0.00034 degrees, about 38 m
POLAR = 88.0
POLAR_LEVEL = 6  # 64 columns
DOWN = 4     # levels between a searched cell and its parts
LEVEL_STEP = 2  # only every second level is used: half the rows, cells of at most 4 r
COARSEST = 2  # cells of 90 degrees; beyond them the whole globe is searched
KM_PER_DEGREE = EARTH_KM * math.pi / 180.0


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cell(lat: Column, lon: Column, level: Column) -> tuple[Column, Column]:
    side = _side(level)
    cy = F.floor((lat + 90.0) / side).cast("int")
    cx = F.pmod(F.floor((lon + 180.0) / side), F.pow(F.lit(2.0), level)).cast("int")
    return cy, cx


def _at_all_levels(df: DataFrame, lat: str, lon: str, finest: int) -> DataFrame:
    leveled = df.withColumn("_level", F.explode(F.sequence(F.lit(COARSEST), F.lit(finest), F.lit(LEVEL_STEP))))
    cy, cx = _cell(F.col(lat), F.col(lon), F.col("_level"))
    return leveled.withColumns({"_cy": cy, "_cx": cx})


def nearest_point(
    queries: DataFrame, points: DataFrame, by: list[str],
    q_lat: str = "latitude", q_lon: str = "longitude",
    p_lat: str = "p_lat", p_lon: str = "p_lon", finest: int = FINEST, decimals: int = 6,
    want: str | None = None, has: str | None = None,
) -> DataFrame:
    """(by, q_lat, q_lon, p_lat, p_lon, distance_km) for each distinct query position.

    Ties within ``decimals`` of a kilometre go to the smaller latitude, then longitude.
    Both inputs are reduced to distinct positions per ``by`` group first, so a hot
    position costs one row. ``want`` and ``has`` name bit masks (long) of the queries and
    the points: then the result has one row for each distinct (position, want), with the
    nearest point whose mask shares a bit, and none where no point does. A position may
    have a few dozen different masks; they ride in one row while the cells are joined.
    Positions, occupied cells and the cells left are stored in the shared folder, so that no
    plan holds more than one of the steps above. All joins are merge joins: a stored table is
    small on disk and large as a hash table, which the driver would have to build.
    """
    mask = F.col(want) if want else F.lit(1)
    q = written(queries.select(*by, q_lat, q_lon, mask.cast("long").alias("_want")).groupBy(
        *by, q_lat, q_lon).agg(F.collect_set("_want").alias("_wants")), "nearest-queries")
    bits = F.col(has) if has else F.lit(1)
    p = written(points.select(*by, p_lat, p_lon, bits.cast("long").alias("_has")).groupBy(
        *by, p_lat, p_lon).agg(F.bit_or("_has").alias("_has")), "nearest-points")
    p_cells = _at_all_levels(p, p_lat, p_lon, finest)
    cell_keys = [*by, "_level", "_cy", "_cx"]
    query_keys = [*by, q_lat, q_lon, "_want"]
    fits = F.col("_has").bitwiseAND(F.col("_want")) != 0

    # 1. some fitting point in the finest shared cell: its diagonal bounds the search
    occupied = written(p_cells.groupBy(*cell_keys).agg(F.bit_or("_has").alias("_has")), "nearest-cells")
    seen = (
        _at_all_levels(q, q_lat, q_lon, finest).join(occupied.hint("merge"), cell_keys, "left")
        .groupBy(*by, q_lat, q_lon)
        .agg(F.collect_list(F.struct("_level", "_has")).alias("_seen"), F.any_value("_wants").alias("_wants")))
    bound = seen.withColumn("_want", F.explode("_wants")).withColumn("_level", F.array_max(F.transform(
        F.filter("_seen", lambda c: c["_has"].bitwiseAND(F.col("_want")) != 0), lambda c: c["_level"]))).select(
        *query_keys, F.coalesce(_side(F.col("_level")) * math.sqrt(2.0) * 1.000001, F.lit(180.0)).alias("_r"))

    # 2. the cells that the circle can touch, at the finest level with cells >= r
    level = F.least(F.lit(finest), F.greatest(
        F.lit(COARSEST), F.floor(F.log2(F.lit(360.0) / F.col("_r"))))).cast("int")
    level = level - level % LEVEL_STEP
    lat, lon, r = F.col(q_lat), F.col(q_lon), F.col("_r")
    # a circle near a pole touches all columns: stay where there are few
    polar = F.abs(lat) + r >= POLAR
    level = F.when(polar, F.least(level, F.lit(POLAR_LEVEL))).otherwise(level)
    side = _side(F.col("_level"))
    reach = F.degrees(F.asin(F.least(
        F.lit(1.0), F.sin(F.radians(r)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9)))))
    wide = polar | (r >= 90.0) | (2.0 * reach + side >= 360.0)
    columns = F.pow(F.lit(2.0), F.col("_level")).cast("int")
    x_lo = F.when(wide, 0).otherwise(F.floor((lon - reach + 180.0) / side).cast("int"))
    x_hi = F.when(wide, columns - 1).otherwise(F.floor((lon + reach + 180.0) / side).cast("int"))
    searched = (
        bound.withColumn("_level", level)
        .withColumn("_cy", F.explode(F.sequence(
            F.floor((F.greatest(lat - r, F.lit(-90.0)) + 90.0) / side).cast("int"),
            F.floor((F.least(lat + r, F.lit(90.0)) + 90.0) / side).cast("int"))))
        .withColumn("_cx", F.explode(F.sequence(x_lo, x_hi)))
        .withColumn("_cx", F.pmod(F.col("_cx"), columns))
        .drop("_r")
    )

    # 3. their occupied parts; no point of a cell is farther from its centre than half the diagonal
    own = F.col("_level")
    parents = F.filter(
        F.array(own - DOWN, *[F.when(own == finest, own - k) for k in range(0, DOWN, LEVEL_STEP)]),
        lambda v: v >= COARSEST)
    parts = (
        occupied.withColumn("_up", F.explode(parents))
        .withColumn("_shift", F.pow(F.lit(2.0), own - F.col("_up")))
        .select(*by, F.col("_up").alias("_level"),
                F.floor(F.col("_cy") / F.col("_shift")).cast("int").alias("_cy"),
                F.floor(F.col("_cx") / F.col("_shift")).cast("int").alias("_cx"),
                own.alias("_sub"), F.col("_cy").alias("_sy"), F.col("_cx").alias("_sx"), "_has"))
    part_side = _side(F.col("_sub"))
    centre = haversine_km(
        F.col(q_lat), F.col(q_lon), F.least(F.lit(90.0), (F.col("_sy") + 0.5) * part_side - 90.0),
        (F.col("_sx") + 0.5) * part_side - 180.0)
    slack = KM_PER_DEGREE * math.sqrt(0.5) * 1.000001 * part_side + 1e-4
    per_query = Window.partitionBy(*query_keys)  # at most 256 parts of a few cells
    left = written(
        searched.join(parts.hint("merge"), cell_keys).where(fits).withColumn("_km", centre)
        .withColumn("_best", F.min(F.col("_km") + slack).over(per_query))
        .where(F.col("_km") - slack <= F.col("_best"))
        .select(*query_keys, F.col("_sub").alias("_level"), F.col("_sy").alias("_cy"), F.col("_sx").alias("_cx")), "nearest-parts")

    # 4. the points themselves
    pairs = left.join(p_cells.hint("merge"), cell_keys).where(fits)
    km = haversine_km(F.col(q_lat), F.col(q_lon), F.col(p_lat), F.col(p_lon))
    best = pairs.groupBy(*query_keys).agg(
        F.min(F.struct(F.round(km, decimals).alias("km"), F.col(p_lat), F.col(p_lon))).alias("_b"))
    return best.select(
        *by, q_lat, q_lon, *([F.col("_want").alias(want)] if want else []),
        F.col(f"_b.{p_lat}").alias(p_lat), F.col(f"_b.{p_lon}").alias(p_lon),
        F.col("_b.km").alias("distance_km"))
