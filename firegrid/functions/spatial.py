"""Spatial columns: UTM cells, great-circle distance, lattice coordinates.

The transverse Mercator series is the public WGS84 expansion; every function maps
columns to columns, so a filter or projection using it stays in one codegen stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Fixed values of the WGS84 ellipsoid and the UTM projection.
RADIUS = 6378137.0
ECC = 0.00669438
SCALE = 0.9996
BANDS = "CDEFGHJKLMNPQRSTUVWXX"

ECC_P = ECC / (1.0 - ECC)
M1 = 1 - ECC / 4 - 3 * ECC**2 / 64 - 5 * ECC**3 / 256
M2 = 3 * ECC / 8 + 3 * ECC**2 / 32 + 45 * ECC**3 / 1024
M3 = 15 * ECC**2 / 256 + 45 * ECC**3 / 1024
M4 = 35 * ECC**3 / 3072
_E1 = (1 - math.sqrt(1 - ECC)) / (1 + math.sqrt(1 - ECC))
P2 = 3 * _E1 / 2 - 27 * _E1**3 / 32 + 269 * _E1**5 / 512
P3 = 21 * _E1**2 / 16 - 55 * _E1**4 / 32
P4 = 151 * _E1**3 / 96 - 417 * _E1**5 / 128
P5 = 1097 * _E1**4 / 512


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utm_zone(lat, lon) -> Column:
    """Zone number with the Norway and Svalbard exceptions; 180 degrees east wraps to zone 1."""
    lat, lon = _col(lat), _col(lon)
    plain = (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")
    svalbard = (lat >= 72.0) & (lat < 84.0) & (lon >= 0.0) & (lon < 42.0)
    return (
        F.when((lat >= 56.0) & (lat < 64.0) & (lon >= 3.0) & (lon < 12.0), F.lit(32))
        .when(svalbard & (lon < 9.0), F.lit(31))
        .when(svalbard & (lon < 21.0), F.lit(33))
        .when(svalbard & (lon < 33.0), F.lit(35))
        .when(svalbard, F.lit(37))
        .otherwise(plain)
    )


def utm_band(lat) -> Column:
    """Latitude band letter for -80 <= lat < 84, else NULL."""
    lat = _col(lat)
    pos = F.floor((lat + 80.0) / 8.0).cast("int") + 1
    return F.when((lat >= -80.0) & (lat < 84.0), F.substring(F.lit(BANDS), pos, F.lit(1)))


def with_utm(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add ``_east`` and ``_north`` in metres, ``_zone`` and ``_band``.

    Shared terms are columns of their own: each projection uses the terms of the one before
    several times, so they are evaluated once per row and the generated code stays small.
    """
    df = df.withColumns({"_zone": utm_zone(lat, lon), "_band": utm_band(lat), "_phi": F.radians(_col(lat))})
    df = df.withColumns({
        "_sin": F.sin("_phi"), "_cos": F.cos("_phi"), "_tan": F.tan("_phi"),
        "_s2": F.sin(2.0 * F.col("_phi")), "_c2": F.cos(2.0 * F.col("_phi")),
        "_dl": F.radians(_col(lon) - ((F.col("_zone") - 1) * 6.0 - 177.0))})
    phi, sin, cos, tan, s2, c2 = (F.col(c) for c in ("_phi", "_sin", "_cos", "_tan", "_s2", "_c2"))
    s4, c4 = 2.0 * s2 * c2, 1.0 - 2.0 * s2 * s2
    s6 = s4 * c2 + c4 * s2
    df = df.withColumns({
        "_c": ECC_P * cos * cos, "_t": tan * tan, "_n": RADIUS / F.sqrt(1.0 - ECC * sin * sin),
        "_a": cos * F.col("_dl"), "_m": RADIUS * (M1 * phi - M2 * s2 + M3 * s4 - M4 * s6)})
    df = df.withColumn("_a2", F.col("_a") * F.col("_a"))
    c, t, n, a, a2, m = (F.col(x) for x in ("_c", "_t", "_n", "_a", "_a2", "_m"))
    east = SCALE * n * a * (
        1.0 + a2 / 6.0 * (1.0 - t + c)
        + a2 * a2 / 120.0 * (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * ECC_P)) + 500000.0
    north = SCALE * (m + n * tan * a2 * (
        0.5 + a2 / 24.0 * (5.0 - t + 9.0 * c + 4.0 * c * c)
        + a2 * a2 / 720.0 * (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * ECC_P)))
    south = F.when(_col(lat) < 0.0, 1e7).otherwise(0.0)
    return df.withColumns({"_east": east, "_north": north + south}).drop(
        "_phi", "_sin", "_cos", "_tan", "_s2", "_c2", "_dl", "_c", "_t", "_n", "_a", "_a2", "_m")


def with_cell(
    df: DataFrame, size_km: float = 1, lat: str = "latitude", lon: str = "longitude", out: str = "grid_id"
) -> DataFrame:
    """Add the cell id ``<zone><band>_<east>_<north>``, NULL outside the UTM domain.

    The id leaves through a one-row generator. A later join on it implies ``IS NOT NULL``;
    pushed through plain projections, this filter would repeat the whole series below.
    """
    side = float(size_km) * 1000.0
    cell = F.concat(
        F.col("_zone").cast("string"), "_band", F.lit("_"), F.floor(F.col("_east") / side).cast("string"),
        F.lit("_"), F.floor(F.col("_north") / side).cast("string"))
    keep = [c for c in df.columns if c != out]
    return with_utm(df, lat, lon).select(*keep, F.inline(F.array(F.struct(cell.alias(out)))))


def with_centre(df: DataFrame, cell: str = "grid_id", size_km: float = 1) -> DataFrame:
    """Add ``latitude`` and ``longitude`` of the middle of a cell id."""
    side = float(size_km) * 1000.0
    keep = [c for c in df.columns if c not in ("latitude", "longitude")]
    part = F.split(cell, "_")
    head = F.get(part, F.lit(0))
    y = F.get(part, F.lit(2)).try_cast("double") * side + side / 2.0
    y = y - F.when(F.substring(head, -1, 1) < "N", 1e7).otherwise(0.0)
    df = df.select(
        *keep, F.regexp_extract(head, r"^(\d+)", 1).try_cast("int").alias("_zone"),
        (F.get(part, F.lit(1)).try_cast("double") * side + side / 2.0 - 500000.0).alias("_x"),
        (y / SCALE / (RADIUS * M1)).alias("_mu"))
    mu = F.col("_mu")
    df = df.withColumn("_p", mu + P2 * F.sin(2.0 * mu) + P3 * F.sin(4.0 * mu)
                       + P4 * F.sin(6.0 * mu) + P5 * F.sin(8.0 * mu))
    df = df.withColumns({"_cos": F.cos("_p"), "_tan": F.tan("_p"), "_ep": 1.0 - ECC * F.pow(F.sin("_p"), F.lit(2.0))})
    df = df.withColumns({
        "_t": F.col("_tan") * F.col("_tan"), "_c": ECC_P * F.col("_cos") * F.col("_cos"),
        "_d": F.col("_x") * F.sqrt("_ep") / (RADIUS * SCALE)})
    df = df.withColumn("_d2", F.col("_d") * F.col("_d"))
    t, c, d, d2 = (F.col(x) for x in ("_t", "_c", "_d", "_d2"))
    shift = F.col("_tan") * F.col("_ep") / (1.0 - ECC)
    lat = F.col("_p") - shift * d2 * (
        0.5 - d2 / 24.0 * (5.0 + 3.0 * t + 10.0 * c - 4.0 * c * c - 9.0 * ECC_P)
    ) + d2 * d2 * d2 / 720.0 * (61.0 + 90.0 * t + 298.0 * c + 45.0 * t * t - 252.0 * ECC_P - 3.0 * c * c)
    lon = d * (1.0 - d2 / 6.0 * (1.0 + 2.0 * t + c) + d2 * d2 / 120.0 * (
        5.0 - 2.0 * c + 28.0 * t - 3.0 * c * c + 8.0 * ECC_P + 24.0 * t * t)) / F.col("_cos")
    return df.select(*keep, F.degrees(lat).alias("latitude"),
                     (F.degrees(lon) + (F.col("_zone") - 1) * 6.0 - 177.0).alias("longitude"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    u = F.sin((lat2 - lat1) / 2.0)
    v = F.sin((lon2 - lon1) / 2.0)
    h = u * u + F.cos(lat1) * F.cos(lat2) * v * v
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
