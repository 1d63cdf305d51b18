"""Views that give the star-schema test tables the shape of fire and weather data.

``SQL`` holds the same views as text for the checking engine; the functions build them as
DataFrames. Coordinates follow from keys, so hot customers become hot locations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.session import DEFAULTS

# Own ten-point outline (lon, lat); the last point connects to the first.
OUTLINE = [
    (-124.303, 42.013), (-120.003, 42.013), (-120.003, 39.007), (-114.607, 35.003), (-114.607, 32.713),
    (-117.207, 32.513), (-118.603, 34.017), (-120.703, 34.513), (-122.003, 36.607), (-123.907, 39.507),
]

SQL = {
    "weather_v": """
SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date,
  32.5e0 + CAST((l_suppkey*37)%95 AS DOUBLE)/10e0 + floor(l_suppkey/9785e0)/1000e0 AS latitude,
  -124.4e0 + CAST((l_suppkey*53)%103 AS DOUBLE)/10e0 AS longitude,
  MAX(l_quantity) AS tmax, ROUND(MIN(l_discount)*100e0,2) AS ppt, ROUND(MAX(l_tax)*50e0,2) AS vbdmax
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "raw_weather_v": """
SELECT l_orderkey AS row_key, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_orderkey%200=0 THEN 91e0 ELSE 32.5e0 + CAST((l_suppkey*37)%95 AS DOUBLE)/10e0 + floor(l_suppkey/9785e0)/1000e0 END AS latitude,
  -124.4e0 + CAST((l_suppkey*53)%103 AS DOUBLE)/10e0 AS longitude, l_quantity AS tmax,
  CASE WHEN l_partkey%20=0 THEN -9999e0 ELSE ROUND(l_discount*100e0,2) END AS ppt,
  CASE WHEN l_partkey%25=0 THEN -9999e0 ELSE ROUND(l_tax*50e0,2) END AS vbdmax,
  CASE WHEN l_linenumber>2 THEN -9999e0 ELSE 50e0 END AS humidity
FROM lineitem""",
    "fire_v": """
SELECT o_orderkey AS fire_key,
  32.5e0 + CAST((o_custkey*29)%95 AS DOUBLE)/10e0 AS latitude,
  -124.4e0 + CAST((o_custkey*31)%103 AS DOUBLE)/10e0 AS longitude,
  290e0 + CAST(o_orderkey%800 AS DOUBLE)/10e0 AS brightness, ROUND(o_totalprice/1000e0,3) AS frp,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'h' WHEN o_orderpriority='5-LOW' THEN 'l' ELSE 'n' END AS confidence,
  CASE WHEN o_orderstatus='P' THEN 2 ELSE 0 END AS type, CAST(o_orderdate AS DATE) AS acq_date
FROM orders""",
    "score_v": """
SELECT o_orderkey AS row_key, CASE WHEN o_totalprice>250000e0 THEN 1 ELSE 0 END AS label,
  ROUND(0.6e0*(o_totalprice/600000e0)+0.4e0*(CAST(o_custkey%97 AS DOUBLE)/97e0),3) AS score,
  CASE WHEN o_orderkey%10<6 THEN 'train' WHEN o_orderkey%10<8 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN o_custkey%2=0 THEN 'a' ELSE 'b' END AS model
FROM orders""",
}


def _place(station: Column) -> tuple[Column, Column]:
    """A place of its own for each station: 95 by 103 lattice points, shifted after each 9,785 keys."""
    lat = F.lit(32.5) + ((station * 37) % 95).cast("double") / 10.0 + F.floor(station / 9785.0) / 1000.0
    return lat, F.lit(-124.4) + ((station * 53) % 103).cast("double") / 10.0


class Tables:
    """The test tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # days are UTC days
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", DEFAULTS["spark.sql.codegen.hugeMethodLimit"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def weather(self) -> DataFrame:
        days = self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("date")).agg(
            F.max("l_quantity").alias("tmax"),
            F.round(F.min("l_discount") * 100.0, 2).alias("ppt"),
            F.round(F.max("l_tax") * 50.0, 2).alias("vbdmax"))
        lat, lon = _place(F.col("station"))
        return days.select(
            "station", "date", lat.alias("latitude"), lon.alias("longitude"),
            "tmax", "ppt", "vbdmax")

    def raw_weather(self) -> DataFrame:
        lat, lon = _place(F.col("l_suppkey"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("row_key"), F.to_date("l_shipdate").alias("date"),
            F.when(F.col("l_orderkey") % 200 == 0, 91.0).otherwise(lat).alias("latitude"), lon.alias("longitude"),
            F.col("l_quantity").alias("tmax"),
            F.when(F.col("l_partkey") % 20 == 0, -9999.0).otherwise(
                F.round(F.col("l_discount") * 100.0, 2)).alias("ppt"),
            F.when(F.col("l_partkey") % 25 == 0, -9999.0).otherwise(
                F.round(F.col("l_tax") * 50.0, 2)).alias("vbdmax"),
            F.when(F.col("l_linenumber") > 2, -9999.0).otherwise(50.0).alias("humidity"))

    def fires(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("fire_key"),
            (F.lit(32.5) + ((F.col("o_custkey") * 29) % 95).cast("double") / 10.0).alias("latitude"),
            (F.lit(-124.4) + ((F.col("o_custkey") * 31) % 103).cast("double") / 10.0).alias("longitude"),
            (F.lit(290.0) + (F.col("o_orderkey") % 800).cast("double") / 10.0).alias("brightness"),
            F.round(F.col("o_totalprice") / 1000.0, 3).alias("frp"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "h")
            .when(F.col("o_orderpriority") == "5-LOW", "l").otherwise("n").alias("confidence"),
            F.when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("type"),
            F.to_date("o_orderdate").alias("acq_date"))

    def scores(self) -> DataFrame:
        part = F.col("o_orderkey") % 10
        return self.table("orders").select(
            F.col("o_orderkey").alias("row_key"),
            F.when(F.col("o_totalprice") > 250000.0, 1).otherwise(0).alias("label"),
            F.round(F.lit(0.6) * (F.col("o_totalprice") / 600000.0)
                    + F.lit(0.4) * ((F.col("o_custkey") % 97).cast("double") / 97.0), 3).alias("score"),
            F.when(part < 6, "train").when(part < 8, "val").otherwise("test").alias("split"),
            F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("model"))
