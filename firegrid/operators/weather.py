"""Weather features per location and 7-day bin.

Input: one row per (longitude, latitude, date); a bin of a location then has at most
``chunk_days`` rows. All windows share one partitioning and so one shuffle of the rows; the
per-bin statistics read the input again and come back as one row per bin. A ``location_key``
(``with_location_key``) takes the place of the two coordinates: grouping by doubles first normalises
them, so only a table bucketed by such a key needs no shuffle at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.calendar import cycle
from firegrid.functions.scalar import bin_right_closed, flag
from firegrid.operators.quantiles import quantiles_wide

LOC = ("longitude", "latitude", "date_bin")
KEYED = ("location_key", "date_bin")
EPS = 1e-8


@dataclass(frozen=True)
class Features:
    """Switches and thresholds of the feature set."""

    hot_dry: bool = True
    spi: bool = True
    vpd: bool = True
    temporal: bool = True
    rolling: bool = True
    compound: bool = True
    scaled: bool = True
    chunk_days: int | None = 7
    hot_above: float = 25.0
    dry_below: float = 1.0
    lookback: int = 7
    extreme_percentile: float = 0.9


def date_span(df: DataFrame, date: str = "date") -> Column:
    """Scalar subquery struct(lo, hi): first and last day."""
    return df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("s")).scalar()


def bin_starts(df: DataFrame, span: Column, chunk_days: int | None = 7, date: str = "date") -> DataFrame:
    """Add ``date_bin`` as the first day of the bin: a four-byte key for windows and joins."""
    lo = span["lo"]
    start = lo if chunk_days is None else F.date_sub(date, F.datediff(date, lo) % chunk_days)
    return df.withColumn("date_bin", start)


def label_bins(df: DataFrame, span: Column, chunk_days: int | None = 7) -> DataFrame:
    """Turn the bin's first day into the text ``start_end``, the end capped at the last day."""
    end = span["hi"]
    if chunk_days is not None:
        end = F.least(F.date_add("date_bin", chunk_days - 1), end)
    label = F.concat_ws("_", F.col("date_bin").cast("string"), end.cast("string"))
    return df.withColumn("date_bin", label)


def date_bins(df: DataFrame, chunk_days: int | None = 7, date: str = "date") -> DataFrame:
    """Add ``date_bin`` (``start_end``, end capped at the last day) counted from the first day.

    ``chunk_days=None`` puts the whole history into one bin.
    """
    span = date_span(df, date)
    return label_bins(bin_starts(df, span, chunk_days, date), span, chunk_days)


def _minmax(x: Column, w) -> Column:
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + EPS)


def with_location_key(df: DataFrame) -> DataFrame:
    """Add ``location_key``, a text that is equal for equal coordinates only (-0.0 equals 0.0, NULL equals NULL)."""
    parts = (F.coalesce((F.col(c) + F.lit(0.0)).cast("string"), F.lit("-")) for c in LOC[:2])
    return df.withColumn("location_key", F.concat_ws(" ", *parts))


def location_bin(df: DataFrame) -> tuple[str, ...]:
    """The columns that name a bin of a location."""
    return KEYED if "location_key" in df.columns else LOC


def hot_dry_index(
    df: DataFrame, hot_above: float = 25.0, dry_below: float = 1.0,
    tmax: str = "tmax", ppt: str = "ppt",
) -> DataFrame:
    """Scaled heat plus inverted scaled rain, and the three day flags."""
    if not {tmax, ppt, *LOC} <= set(df.columns):
        return df.withColumn("hot_dry_index", F.lit(0.0))
    w = Window.partitionBy(*location_bin(df))
    t, p = F.col(tmax), F.col(ppt)
    hot, dry = flag(t > hot_above), flag(p < dry_below)
    return df.withColumns({
        "hot_dry_index": _minmax(t, w) + (1.0 - _minmax(p, w)),
        "high_temp_day": hot,
        "low_rain_day": dry,
        "hot_dry_day": hot * dry,
    })


def _trailing(df: DataFrame, rows: int):
    return Window.partitionBy(*location_bin(df)).orderBy("date").rowsBetween(1 - rows, 0)


def _enough(x: Column, w, min_rows: int, value: Column) -> Column:
    return value if min_rows <= 1 else F.when(F.count(x).over(w) >= min_rows, value)


def spi(df: DataFrame, lookback: int = 7, min_rows: int = 1, ppt: str = "ppt") -> DataFrame:
    """(rolling sum - rolling mean) / rolling deviation, NULL or zero spread giving 0, and its class.

    The published formula never goes below 0 for rain >= 0; it is kept.
    """
    if not {ppt, *LOC, "date"} <= set(df.columns):
        return df.withColumns({"spi_7day": F.lit(0.0), "drought_category": F.lit(0)})
    w, p = _trailing(df, lookback), F.col(ppt)
    total, mean, dev = F.sum(p).over(w), F.avg(p).over(w), F.stddev_samp(p).over(w)
    index = F.coalesce(
        F.try_divide(_enough(p, w, min_rows, total - mean), F.nullif(dev, F.lit(0.0))), F.lit(0.0))
    df = df.withColumn("spi_7day", index)
    return df.withColumn("drought_category", bin_right_closed(
        F.col("spi_7day"), [-2.0, -1.5, -1.0, -0.5, 0.5], [5, 4, 3, 2, 1, 0]))


def vpd_extremes(df: DataFrame, percentile: float = 0.9, vpd: str = "vbdmax") -> DataFrame:
    """Above the location's percentile, and the z-score (0 without spread)."""
    if not {vpd, *LOC} <= set(df.columns):
        return df.withColumns({"vpd_extreme": F.lit(0), "vpd_anomaly": F.lit(0.0)})
    w, v = Window.partitionBy(*location_bin(df)), F.col(vpd)
    limit = F.percentile(v, F.lit(percentile)).over(w)
    score = F.try_divide(v - F.avg(v).over(w), F.nullif(F.stddev_samp(v).over(w), F.lit(0.0)))
    return df.withColumns({
        "vpd_extreme": flag(v > limit), "vpd_anomaly": F.coalesce(score, F.lit(0.0))})


def _rank_edges(df: DataFrame, vpd: str) -> DataFrame:
    """Quintile edges of the rank shares of a bin, from group sizes alone.

    A location with n values contributes exactly 1/n .. n/n, so counting locations per
    (bin, n) yields the whole distribution without ranking anything.
    """
    sizes = df.groupBy(*location_bin(df)).agg(F.count(vpd).alias("n")).where("n > 0")
    same = sizes.groupBy("date_bin", "n").agg(F.count(F.lit(1)).alias("m"))
    places = same.select("date_bin", "n", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    shares = places.select("date_bin", "m", (F.col("k") / F.col("n")).alias("share"))
    cuts = F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])
    return shares.groupBy("date_bin").agg(F.percentile("share", cuts, F.col("m")).alias("edges"))


def vpd_risk(df: DataFrame, vpd: str = "vbdmax", base: DataFrame | None = None) -> DataFrame:
    """Quintile class of the rank share within the location, cut over the whole bin.

    ``base`` may be a shorter plan with the same rows, from which the edges are taken.
    """
    if not {vpd, *LOC} <= set(df.columns):
        return df.withColumn("vpd_risk_category", F.lit(1))
    return _risk(_ranked(df, vpd), _rank_edges(df if base is None else base, vpd))


def _ranked(df: DataFrame, vpd: str = "vbdmax") -> DataFrame:
    """Add ``_share``, the rank share within the location."""
    w = Window.partitionBy(*location_bin(df))
    order = w.orderBy(F.col(vpd).isNull(), F.col(vpd), F.col("date"))
    share = F.when(
        F.col(vpd).isNotNull(), F.row_number().over(order) / F.count(vpd).over(w))
    return df.withColumn("_share", share)


def _risk(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """The class of ``_share``, which it replaces; ``edges`` has one row per bin of calendar days."""
    joined = ranked.join(F.broadcast(edges), "date_bin", "left")
    s, e = F.col("_share"), F.col("edges")
    category = (
        F.when(s.isNull(), None).when(s <= e[0], 1).when(s <= e[1], 2)
        .when(s <= e[2], 3).when(s <= e[3], 4).otherwise(5))
    kept = [c for c in ranked.columns if c != "_share"]
    return joined.withColumn("vpd_risk_category", category).select(*kept, "vpd_risk_category")


def temporal_features(df: DataFrame, date: str = "date") -> DataFrame:
    if date not in df.columns:
        return df.withColumn("is_fire_season", F.lit(0))
    month, day = F.month(date), F.dayofyear(date)
    week_sin, week_cos = cycle(F.floor(day / 7), 52)
    month_sin, month_cos = cycle(month, 12)
    day_sin, day_cos = cycle(day, 365)
    return df.withColumns({
        "month": month,
        "day_of_year": day,
        "is_fire_season": flag(month.between(6, 10)),
        "is_santa_ana_season": flag((month >= 10) | (month <= 4)),
        "season": F.floor((month % 12) / 3).cast("int"),
        "week_sin": week_sin, "week_cos": week_cos,
        "month_sin": month_sin, "month_cos": month_cos,
        "day_of_year_sin": day_sin, "day_of_year_cos": day_cos,
    })


# Names of the rolling columns.
ROLLING = {"tmax": "tmax_7day_mean", "ppt": "ppt_7day_mean", "vbdmax": "vbd_7day_mean"}


def rolling_means(df: DataFrame, rows: int = 7, min_rows: int = 1) -> DataFrame:
    """Means over the last rows (not days) of the location; an absent measure gives NULL."""
    if not {*LOC, "date"} <= set(df.columns):
        return df
    w = _trailing(df, rows)
    return df.withColumns({
        out: _enough(F.col(c), w, min_rows, F.avg(c).over(w)) if c in df.columns
        else F.lit(None).cast("double")
        for c, out in ROLLING.items()})


def compound_indices(df: DataFrame) -> DataFrame:
    """Fire weather, drought weather and fire risk; weights depend on the inputs present."""
    names = ("fire_weather_index", "drought_weather_index", "fire_risk_index")
    if not set(LOC) <= set(df.columns):
        return df.withColumns({n: F.lit(1.0) for n in names})
    have = {c for c in ("hot_dry_index", "vpd_risk_category", "drought_category", "wind_risk")
            if c in df.columns}
    heat = F.lit(0.0)
    if "hot_dry_index" in have:
        heat = 5.0 * _minmax(F.col("hot_dry_index"), Window.partitionBy(*location_bin(df)))
    df = df.withColumn("_heat", heat)
    parts = {"hot_dry_index": F.col("_heat")}
    for c in ("vpd_risk_category", "drought_category", "wind_risk"):
        parts[c] = F.col(c)

    def blend(weights: dict[str, float]) -> Column:
        """Weighted sum if all inputs are there, else the first present one, else 1."""
        present = [c for c in weights if c in have]
        if len(present) < len(weights):
            return (parts[present[0]] if present else F.lit(1)).cast("double")
        total = None
        for c, k in weights.items():
            total = F.lit(k) * parts[c] if total is None else total + F.lit(k) * parts[c]
        return total

    fire = blend({"hot_dry_index": 0.5, "vpd_risk_category": 0.5})
    drought = blend({"drought_category": 0.7, "hot_dry_index": 0.3})
    if {"hot_dry_index", "vpd_risk_category", "drought_category"} <= have:
        risk = blend(
            {"hot_dry_index": 0.25, "vpd_risk_category": 0.25, "drought_category": 0.25, "wind_risk": 0.25}
            if "wind_risk" in have
            else {"hot_dry_index": 0.33, "vpd_risk_category": 0.33, "drought_category": 0.34})
    else:
        risk = fire
    return df.withColumns(dict(zip(names, (fire, drought, risk)))).drop("_heat")


def robust_scale(
    df: DataFrame, columns: list[str], prefix: str = "normalized_", by: tuple[str, ...] = ("date_bin",),
    base: DataFrame | None = None,
) -> DataFrame:
    """(x - median) / interquartile range per bin; a zero range divides by 1.

    ``base`` may be a shorter plan with the same rows, from which the quartiles are taken.
    """
    q = quantiles_wide(df if base is None else base, columns, [0.25, 0.5, 0.75], list(by))
    names = [f"{c}_q{k}" for c in columns for k in range(3)]
    if by:
        joined = df.join(q.withColumn("_q", F.struct(*names)).drop(*names), list(by), "left")
    else:
        joined = df.withColumn("_q", q.select(F.struct(*names)).scalar())
    scaled = {}
    for c in columns:
        low, middle, high = (F.col(f"_q.{c}_q{k}") for k in range(3))
        scaled[f"{prefix}{c}"] = (F.col(c) - middle) / F.coalesce(
            F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def engineer_features(df: DataFrame, opts: Features = Features()) -> DataFrame:
    """The full feature set for training."""
    have = set(df.columns)
    span = None if "date_bin" in have else date_span(df)
    base = out = df if span is None else bin_starts(df, span, opts.chunk_days)
    risk = opts.vpd and "vbdmax" in have
    ranks = risk and {*LOC[:2], "date"} <= have
    if ranks:  # the one window in another order goes first, while rows are narrow; all others then share one sort by date
        out = _ranked(out)
    if opts.hot_dry and {"tmax", "ppt"} <= have:
        out = hot_dry_index(out, opts.hot_above, opts.dry_below)
    if opts.spi and "ppt" in have:
        out = spi(out, opts.lookback)
    if risk:
        out = vpd_extremes(out, opts.extreme_percentile)
        out = _risk(out, _rank_edges(base, "vbdmax")) if ranks else vpd_risk(out, base=base)
    if opts.temporal:
        out = temporal_features(out)
    if opts.rolling:
        out = rolling_means(out, opts.lookback)
    if opts.compound:
        out = compound_indices(out)
    scalable = [c for c in ("tmax", "ppt", "vbdmax") if c in have]
    if opts.scaled and scalable:
        out = robust_scale(out, scalable, base=base)
    return out if span is None else label_bins(out, span, opts.chunk_days)


def feature_run_summary(df: DataFrame, chunk_days: int = 7, date: str = "date") -> DataFrame:
    """One row: rows, first and last day, days between them, number of bins with data."""
    span = df.agg(
        F.count(F.lit(1)).alias("total_rows_processed"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"))
    bins = date_bins(df, chunk_days, date).agg(F.count_distinct("date_bin")).scalar()
    return span.withColumns({
        "total_date_range_days": F.datediff("last_date", "first_date"),
        "chunk_interval_days": F.lit(chunk_days),
        "total_chunks_processed": bins,
    })
