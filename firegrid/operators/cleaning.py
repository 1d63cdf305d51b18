"""Row and column cleaning, filters and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.functions.scalar import flag
from firegrid.operators.quantiles import quantiles_wide

SENTINELS = (-9999.0,)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates collapse before the shuffle through partial aggregation."""
    return df.dropDuplicates()


def valid_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with both coordinates; a missing column is an error."""
    absent = [c for c in (lat, lon) if c not in df.columns]
    if absent:
        raise ValueError(f"missing coordinate columns: {absent}")
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def in_coordinate_range(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0))


def sentinels_to_null(df: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """Replace each missing-value marker by NULL in every numeric column."""
    marked = {
        name: F.when(~F.col(name).isin(*sentinels), F.col(name)) for name in numeric_columns(df)
    }
    return df.withColumns(marked)


def _null_share(name: str) -> Column:
    return F.avg(F.col(name).isNull().cast("double")) * 100.0


def missing_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_pct) from one pass over the table."""
    columns = columns or df.columns
    shares = df.agg(*[_null_share(c).alias(c) for c in columns])
    return shares.unpivot([], columns, "column_name", "missing_pct")


def missing_by_column(df: DataFrame) -> dict[str, float]:
    """Missing percent per column. The driver sees one row: it decides the schema from here on."""
    row = df.agg(*[_null_share(c).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def drop_sparse_columns(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Drop the columns missing in more than ``threshold`` percent of rows."""
    return df.drop(*[c for c, share in missing_by_column(df).items() if share > threshold])


def fill_with_daily_median(
    df: DataFrame, columns: list[str] | None = None, day: str = "date"
) -> DataFrame:
    """Fill NULLs with the exact median of the same day.

    A day may hold any number of rows: only the value range that holds the median is sorted.
    One row per day is left; the planner chooses how to join it.
    """
    columns = columns or numeric_columns(df)
    medians = quantiles_wide(df, columns, [0.5], [day])
    joined = df.join(medians, day, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}_q0")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def clean_weather(
    df: DataFrame, day: str = "date", sentinels=SENTINELS, threshold: float = 50.0,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Markers to NULL, sparse columns out, daily medians in, duplicates and bad points out.

    A day is the unit, as one raw file holds one day: a column missing in more than ``threshold``
    percent of a day's rows is NULL for that whole day and not filled. Columns that no day keeps
    are dropped. Rows without a day count as one day more, without a median. ``keys`` are
    identifier columns that are neither emptied nor filled.
    """
    df = sentinels_to_null(df, sentinels)
    columns = [c for c in df.columns if c not in (day, *keys)]
    shares = df.groupBy(F.col(day).alias("_day")).agg(*[_null_share(c).alias(f"_s_{c}") for c in columns])
    # The driver sees one row: it decides the schema from here on.
    span = shares.agg(*[f(f"_s_{c}").alias(f"{e}_{c}") for c in columns for e, f in (("lo", F.min), ("hi", F.max))]).first()
    dropped = [c for c in columns if (span[f"lo_{c}"] or 0.0) > threshold]
    emptied = [c for c in columns if c not in dropped and (span[f"hi_{c}"] or 0.0) > threshold]
    gaps = [c for c in numeric_columns(df) if c in columns and c not in dropped and (span[f"hi_{c}"] or 0.0) > 0.0]
    df = df.drop(*dropped)
    if gaps:
        df = fill_with_daily_median(df, gaps, day)
    if emptied:
        joined = df.join(shares, df[day].eqNullSafe(shares["_day"]), "left")
        kept = {c: F.when(F.col(f"_s_{c}") <= threshold, F.col(c)) for c in emptied}
        df = joined.withColumns(kept).select(*df.columns)
    df = drop_duplicate_rows(df)
    return in_coordinate_range(df) if {"latitude", "longitude"} <= set(df.columns) else df


def one_row_per_day(df: DataFrame, location=("longitude", "latitude"), day: str = "date") -> DataFrame:
    """One row per location and day (the smallest by value), reduced before the shuffle.

    It drops the other rows, so no flow calls it: it is the caller's choice where a feed
    holds several readings of a location and day.
    """
    keys = [*location, day]
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return least.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def confidence_filter(df: DataFrame, drop_low: bool = True, column: str = "confidence") -> DataFrame:
    """Keep nominal and high (and, if asked, low) detections; absent column: no change."""
    if column not in df.columns:
        return df
    return df.where(F.col(column).isin(*(["n", "h"] if drop_low else ["l", "n", "h"])))


def vegetation_fires(df: DataFrame, column: str = "type") -> DataFrame:
    """Keep detections of type 0."""
    return df.where(F.col(column) == 0)


# Columns the published pipeline does not use.
UNUSED_COLUMNS = ("scan", "track", "version", "satellite", "instrument", "bright_t31")


def drop_columns(df: DataFrame, columns=UNUSED_COLUMNS) -> DataFrame:
    """Absent names are ignored."""
    return df.drop(*columns)


def repair_columns(df: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Fix the known misspelling and add absent measure columns with their default."""
    if "longtiude" in df.columns and "longitude" not in df.columns:
        df = df.withColumnRenamed("longtiude", "longitude")
    defaults = defaults or {"frp_log": 0.0, "brightness_normalized": 0.1}
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def derive_label(df: DataFrame, label: str = "fire", power: str = "frp") -> DataFrame:
    """Add the 0/1 label when the table has none."""
    return df if label in df.columns else df.withColumn(label, flag(F.col(power) > 0))


def feature_list(df: DataFrame, wanted: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(present, absent) feature names; without a list all but four columns are features."""
    if not wanted:
        skip = {"fire", "acq_date", "latitude", "longitude"}
        return [c for c in df.columns if c not in skip], []
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def select_features(
    df: DataFrame, wanted: list[str] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    present, _ = feature_list(df, wanted)
    return df.select(*keep, *[c for c in present if c not in keep])


def bounding_box(
    points: DataFrame, buffer: float = 1.0, by: list[str] | None = None,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Buffered min/max box of the points, per group if asked."""
    aggs = [
        (F.min(lat) - buffer).alias("lat_lo"), (F.max(lat) + buffer).alias("lat_hi"),
        (F.min(lon) - buffer).alias("lon_lo"), (F.max(lon) + buffer).alias("lon_hi"),
    ]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def in_box_of(
    df: DataFrame, points: DataFrame, buffer: float = 1.0,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Rows inside the buffered box of ``points``; the box is a scalar subquery."""
    box = bounding_box(points, buffer)
    edge = {c: box.select(c).scalar() for c in box.columns}
    return df.where(
        (F.col(lat) >= edge["lat_lo"]) & (F.col(lat) <= edge["lat_hi"])
        & (F.col(lon) >= edge["lon_lo"]) & (F.col(lon) <= edge["lon_hi"]))


def keep_known_cell_or_week(
    weather: DataFrame, fires: DataFrame, cell: str = "grid_id", week: str = "week"
) -> DataFrame:
    """Weather rows whose cell or whose week occurs among the fires."""
    cells = fires.select(F.col(cell).alias("_cell")).distinct()
    weeks = fires.select(F.col(week).alias("_week")).distinct()  # one row per calendar week
    joined = (
        weather.join(F.broadcast(weeks), weather[week] == F.col("_week"), "left")
        .join(cells, weather[cell] == F.col("_cell"), "left")
    )
    return joined.where(F.col("_cell").isNotNull() | F.col("_week").isNotNull()).select(*weather.columns)


# The columns every detection table must have.
REQUIRED_COLUMNS = {
    "latitude": "double", "longitude": "double", "brightness": "double", "acq_date": "timestamp",
}


def schema_message(df: DataFrame, required=REQUIRED_COLUMNS, what: str = "table") -> str | None:
    """What is missing from the schema, or None."""
    absent = [c for c in required if c not in df.columns]
    return f"Missing columns {absent} in {what}" if absent else None


def missing_within(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row: the worst missing share and whether it is at most the threshold."""
    shares = [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]
    worst = F.greatest(*shares) if len(shares) > 1 else reduce(lambda a, b: a, shares)
    return df.agg(worst.alias("worst_share")).withColumn("ok", F.col("worst_share") <= threshold)
