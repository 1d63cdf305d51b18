"""Readers and writers. Paths may be any file system Spark can reach."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firegrid.functions.calendar import date_from_name, week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators.weather import with_location_key

MANIFEST = "_finished_years"  # readers of the table skip names with an underscore

# Columns of the raw files.
FIRE_SCHEMA = (
    "latitude double, longitude double, brightness double, scan double, track double, "
    "acq_date date, acq_time string, satellite string, instrument string, confidence string, "
    "version string, bright_t31 double, frp double, daynight string, type int")
WEATHER_SCHEMA = "longitude double, latitude double, ppt double, tmax double, vbdmax double"


def read_fires(spark: SparkSession, path, schema: str = FIRE_SCHEMA) -> DataFrame:
    """Detections from CSV with header; a header that differs from the schema is an error."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, dateFormat="yyyy-MM-dd")


def _has_csv(spark: SparkSession, folder: str) -> bool:
    """Whether any CSV file lies below ``folder``; only file names are listed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    return not listed.load(folder).select("path").isEmpty()


def read_weather_days(
    spark: SparkSession, folder: str, years: list[int] | None = None, schema: str = WEATHER_SCHEMA,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Daily files ``<folder>/<year>/<yyyymmdd>.csv``; the date is read off the file name.

    A day may also be a folder of CSV files, as Spark writes them: ``<yyyymmdd>/`` or
    ``day=<yyyymmdd>/``. Files whose name and folder are no date are skipped; each year without
    any CSV file is an error, and so is a header that differs from the schema. ``dates``
    (first, last) keeps a range of days.
    """
    paths = [f"{folder}/{y}" for y in years] if years else [folder]
    empty = [p for p in paths if not _has_csv(spark, p)]
    if empty:
        raise FileNotFoundError(f"no CSV files below {empty}")
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    rows = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(paths)
    day_folder = date_from_name(F.col("_metadata.file_path"), r"/(?:day=)?(\d{8})/[^/]*$")
    dated = rows.withColumn("date", F.coalesce(date_from_name(F.col("_metadata.file_name")), day_folder))
    dated = dated.where(F.col("date").isNotNull())
    if dates is not None:
        dated = dated.where(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    return dated


def read_boundary(spark: SparkSession, path: str, where: dict[str, str] | None = None) -> DataFrame:
    """Edge table of GeoJSON polygons, one FeatureCollection or one feature per line.

    ``where`` keeps features by property, for example ``{"STATEFP": "06"}``.
    """
    schema = (
        "type string, properties map<string,string>, "
        "geometry struct<type:string,coordinates:string>, "
        "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.explode(
        F.when(F.col("value").contains('"FeatureCollection"'), F.array("value"))
        .otherwise(F.split("value", "\n"))).alias("value")).where(F.trim("value") != "")
    doc = lines.select(F.from_json("value", schema).alias("d"))
    one = F.struct(F.col("d.properties").alias("properties"), F.col("d.geometry").alias("geometry"))
    feature = doc.select(F.explode(
        F.when(F.col("d.features").isNotNull(), F.col("d.features")).otherwise(F.array(one))).alias("f"))
    for name, value in (where or {}).items():
        feature = feature.where(F.col("f.properties")[name] == value)
    ring = "array<array<array<double>>>"
    text = F.col("f.geometry.coordinates")
    polygons = F.when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, f"array<{ring}>")
    ).otherwise(F.array(F.from_json(text, ring)))
    rings = (
        feature.select(F.col("f.properties").alias("properties"), F.posexplode(polygons).alias("polygon", "rs"))
        .select("properties", "polygon", F.posexplode("rs").alias("ring", "pts")))
    ends = F.transform(
        F.slice("pts", 1, F.size("pts") - 1),
        lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"),
            F.col("pts")[i + 1][0].alias("x2"), F.col("pts")[i + 1][1].alias("y2")))
    return rings.select("properties", "polygon", "ring", F.inline(ends))


def scan_weather(
    spark: SparkSession, path: str, year: int | None = None, month: int | None = None,
    box: tuple[float, float, float, float] | None = None, dates: tuple[str, str] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Parquet scan whose year, month, box (lat_lo, lat_hi, lon_lo, lon_hi) and dates are pushed down."""
    df = spark.read.parquet(path)
    tests: list[Column] = []
    if year is not None:
        tests.append(F.col("year") == year)
    if month is not None:
        tests.append(F.col("month") == month)
    if box is not None:
        tests.append(F.col("latitude").between(box[0], box[1]))
        tests.append(F.col("longitude").between(box[2], box[3]))
    if dates is not None:
        tests.append(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    for test in tests:
        df = df.where(test)
    return df.select(*columns) if columns else df


def with_calendar_and_cell(df: DataFrame, size_km: float = 1, date: str = "date") -> DataFrame:
    """Add year, month, day_of_year, grid_id and week."""
    return with_cell(df, size_km).withColumns({
        "year": F.year(date), "month": F.month(date), "day_of_year": F.dayofyear(date),
        "week": week_text(date)})


def write_weather_master(df: DataFrame, path: str, size_km: float = 1) -> None:
    """One snappy Parquet table by year and month; a re-run replaces the months it holds.

    Rows are rebalanced by month: small months share a task, and a large one is split
    by the adaptive planner into files of the advisory size.
    """
    master = with_calendar_and_cell(df, size_km).hint("rebalance", F.col("year"), F.col("month"))
    (master.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month").option("compression", "snappy").parquet(path))


def write_location_table(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The rows of ``df`` with their ``location_key`` as table ``table`` below ``path``, bucketed by the key, sorted by it and date.

    The weather features read it without a shuffle by location. Rows are brought together by the hash
    that buckets use, so each task writes one file; a location has one row a day, so a bucket
    grows with its locations only. Take about one bucket for every 128 MB.
    """
    (with_location_key(df).repartition(buckets, "location_key").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "location_key").sortBy("location_key", "date").saveAsTable(table))
    return df.sparkSession.table(table)


def open_location_table(spark: SparkSession, schema: StructType, table: str, path: str, buckets: int) -> DataFrame:
    """A table of columns ``schema`` that an earlier session wrote with ``write_location_table``; its catalog may have ended with it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, location_key string) USING parquet LOCATION '{place}' "
              f"CLUSTERED BY (location_key) SORTED BY (location_key, date) INTO {buckets} BUCKETS")
    return spark.table(table)


def finished_years(spark: SparkSession, path: str) -> DataFrame:
    """(year): the years a master table at ``path`` holds in full, from the manifest beside its data."""
    try:
        return spark.read.schema("year int").parquet(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "year int")


def write_new_years(
    daily: DataFrame, path: str, size_km: float = 1, prepare: Callable[[DataFrame], DataFrame] | None = None,
    redo: Sequence[int] = (),
) -> list[int]:
    """Add to the master table the years it does not hold yet; returns them.

    Only rows of new years are read past the list of years, run through ``prepare`` (which must
    treat each year alone) and written. A year enters the manifest after its months are in place,
    so a run that died is simply repeated: it overwrites the months it left behind.
    ``redo`` names years to write again, such as one that was not over at the last run.
    Rows without a date belong to no year and are left out.
    """
    spark = daily.sparkSession
    years = daily.where(F.col("date").isNotNull()).select(F.year("date").alias("year"))
    held = finished_years(spark, path).where(~F.col("year").isin(list(redo)))
    new = sorted(r.year for r in pending_years(years, held).collect())  # calendar years
    if new:
        rows = daily.where(F.year("date").isin(new))
        write_weather_master(prepare(rows) if prepare else rows, path, size_km)
        spark.createDataFrame([(y,) for y in new], "year int").coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return new


def write_with_summary(df: DataFrame, path: str, summary_path: str, *summary: Column, by: Sequence[str] = ()) -> None:
    """Write Parquet, and as JSON the ``summary`` aggregates of exactly the rows written.

    The aggregates are observed while the rows are written, so nothing is read a second time.
    They must not be distinct ones.
    """
    seen = Observation()
    df.observe(seen, *summary).write.mode("overwrite").partitionBy(*by).parquet(path)
    shape = df.limit(0).agg(*summary).schema
    write_json_row(df.sparkSession.createDataFrame([tuple(seen.get[f.name] for f in shape)], shape).coalesce(1), summary_path)


def read_json_row(spark: SparkSession, path: str, schema) -> DataFrame:
    """A summary written by ``write_json_row``; a line that is no such JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; the commit protocol publishes all files or none."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json_row(df: DataFrame, path: str) -> None:
    """A one-row summary or metrics frame as JSON."""
    df.write.mode("overwrite").json(path)


def pending_years(available: DataFrame, finished: DataFrame, year: str = "year") -> DataFrame:
    """Years of ``available`` that ``finished`` does not have yet."""
    return available.select(year).distinct().join(finished.select(year).distinct(), year, "left_anti")


def head_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a fixed order."""
    return df.orderBy(*order).limit(n)
