"""Summaries, distributions and scalers."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.functions.scalar import inverse_normal, yeo_johnson
from firegrid.operators.ordering import running_total
from firegrid.operators.quantiles import exact_quantiles, to_long
from firegrid.session import written

METHODS = ("original", "minmax", "zscore")


def spatial_patterns(scored: DataFrame, by: str = "grid_id") -> DataFrame:
    """Per cell (or week): mean, deviation and count of the probability, fires and their rate."""
    return scored.groupBy(by).agg(
        F.avg("fire_probability").alias("mean_probability"),
        F.stddev_samp("fire_probability").alias("std_probability"),
        F.count("fire_probability").alias("sample_count"),
        F.sum("fire_predicted").alias("predicted_fires"),
        F.avg("fire_predicted").alias("fire_rate"),
    )


def top_fire_grids(scored: DataFrame, n: int = 20) -> DataFrame:
    return spatial_patterns(scored).orderBy(F.desc("fire_rate"), "grid_id").limit(n)


def temporal_patterns(scored: DataFrame) -> DataFrame:
    """Per week, with the week as the date of its Monday."""
    from firegrid.functions.calendar import week_text_start
    return spatial_patterns(scored, "week").withColumn("week", week_text_start("week"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form of count, mean, deviation, five-number summary and missing share."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    long = to_long(df, [], columns)
    basic = long.groupBy("variable").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "variable", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return basic.join(q, "variable").withColumns({
        "missing": rows - F.col("count"),
        "missing_pct": F.try_divide((rows - F.col("count")) * 100.0, rows)})


def fires_per_day(fires: DataFrame, date: str = "acq_date") -> DataFrame:
    return fires.groupBy(F.to_date(date).alias("date")).agg(F.count(F.lit(1)).alias("n_fires"))


def sample_skewness(x: str | Column) -> Column:
    """Sample-corrected skewness; NULL below three values."""
    n = F.count(x).cast("double")
    return F.try_divide(F.sqrt(n * (n - 1.0)), F.nullif(n - 2.0, F.lit(0.0))) * F.skewness(x)


def skewness_report(df: DataFrame, column: str, log_column: str) -> DataFrame:
    """Biased and corrected skewness of a measure and of its logarithm, in one pass."""
    return df.agg(
        F.skewness(column).alias("skew_original"), F.skewness(log_column).alias("skew_log"),
        sample_skewness(column).alias("sample_skew_original"),
        sample_skewness(log_column).alias("sample_skew_log"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one pass; each unordered pair is computed once."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("feature_a"), F.lit(right).alias("feature_b"),
                                  F.col(f"c{i}").alias("correlation")))
    return row.select(F.inline(F.array(*cells)))


def _scaled_structs(stats: dict[str, Column]) -> list[tuple[str, Column]]:
    x = F.col("x")
    minmax = F.coalesce(F.try_divide(x - stats["lo"], stats["hi"] - stats["lo"]), F.lit(0.0))
    zscore = F.coalesce(F.try_divide(x - stats["mean"], stats["dev"]), F.lit(0.0))
    return [("original", x), ("minmax", minmax), ("zscore", zscore)]


def scaled_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, method, value) for the original, min-max and z-score versions."""
    long = to_long(df, [], columns)
    stats = long.groupBy("variable").agg(  # one row per column name
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("dev"))
    joined = long.join(F.broadcast(stats), "variable")
    versions = _scaled_structs({c: F.col(c) for c in ("lo", "hi", "mean", "dev")})
    return joined.select("variable", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), v.alias("value")) for m, v in versions])))


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "variable", "value")


def outlier_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of values beyond 1.5 interquartile ranges, per variable and scaling method.

    The scalings keep the order of values, so the quartiles of all three versions follow
    from those of the original.
    """
    q = exact_quantiles(df, columns, [0.25, 0.75]).select("variable", "n", "q0", "q1")
    long = to_long(df, [], columns)
    stats = long.groupBy("variable").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("dev")).join(q, "variable")
    joined = long.join(F.broadcast(stats), "variable")  # one row per column name
    s = {c: F.col(c) for c in ("lo", "hi", "mean", "dev")}

    def versions(x: Column) -> dict[str, Column]:
        return {
            "original": x,
            "minmax": F.coalesce(F.try_divide(x - s["lo"], s["hi"] - s["lo"]), F.lit(0.0)),
            "zscore": F.coalesce(F.try_divide(x - s["mean"], s["dev"]), F.lit(0.0))}

    value, q1, q3 = (versions(F.col(c)) for c in ("x", "q0", "q1"))
    shares = []
    for m in METHODS:
        room = 1.5 * (q3[m] - q1[m])
        outside = (value[m] < q1[m] - room) | (value[m] > q3[m] + room)
        shares.append((F.avg(outside.cast("double")) * 100.0).alias(f"{m}_pct"))
    return joined.groupBy("variable").agg(*shares)


def scaler_comparison(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, deviation and skewness per variable and method, averaged by method."""
    per = scaled_long(df, columns).groupBy("variable", "method").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), sample_skewness("value").alias("skewness"))
    return per.groupBy("method").agg(*[
        F.avg(c).alias(c) for c in ("min", "max", "mean", "std", "skewness")])


def recommend_scaler(
    df: DataFrame, columns: list[str], skew_above: float = 1.0, outliers_above: float = 10.0
) -> DataFrame:
    """Z-Score for skewed or outlier-rich variables, else Min-Max."""
    skew = to_long(df, [], columns).groupBy("variable").agg(sample_skewness("x").alias("skewness"))
    share = outlier_share(df, columns).select("variable", F.col("original_pct").alias("outlier_pct"))
    rough = (F.abs("skewness") > skew_above) | (F.col("outlier_pct") > outliers_above)
    return skew.join(share, "variable").withColumn(
        "method", F.when(rough, "Z-Score").otherwise("Min-Max"))


def scale_minmax(df: DataFrame, columns: list[str], lo: float = 0.0, hi: float = 1.0,
                 prefix: str = "minmax_") -> DataFrame:
    """Linear map of the column's range onto [lo, hi]; a constant column becomes ``lo``."""
    out = {}
    for c in columns:
        bounds = df.agg(F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias("s")).scalar()
        share = F.coalesce(F.try_divide(F.col(c) - bounds["a"], bounds["b"] - bounds["a"]), F.lit(0.0))
        out[f"{prefix}{c}"] = F.when(F.col(c).isNotNull(), share * (hi - lo) + lo)
    return df.withColumns(out)


def scale_zscore(df: DataFrame, columns: list[str], prefix: str = "zscore_") -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    out = {}
    for c in columns:
        s = df.agg(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("d")).alias("s")).scalar()
        out[f"{prefix}{c}"] = F.when(F.col(c).isNotNull(), F.coalesce(
            F.try_divide(F.col(c) - s["m"], s["d"]), F.lit(0.0)))
    return df.withColumns(out)


def scale_robust(df: DataFrame, columns: list[str], prefix: str = "robust_") -> DataFrame:
    """(x - median) / interquartile range over the whole table."""
    from firegrid.operators.weather import robust_scale
    return robust_scale(df, columns, prefix, by=())


def _best_lambda(counts: DataFrame, grid: Column) -> DataFrame:
    """Grid value of largest log-likelihood per variable; ties to the smaller one; none for a constant.

    Each distinct value is expanded to the grid inside the task and summed up map-side.
    """
    terms = counts.withColumn("lam", F.explode(grid))
    terms = terms.withColumn("y", yeo_johnson(F.col("x"), F.col("lam")))
    mean = F.sum(F.col("c") * F.col("y")) / F.sum("c")
    fit = terms.groupBy("variable", "lam").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"),
        (F.sum(F.col("c") * F.col("y") * F.col("y")) / F.sum("c") - mean * mean).alias("v"),
        F.sum(F.col("c") * F.signum("x") * F.log1p(F.abs("x"))).alias("j"))
    score = -F.col("n") / 2.0 * F.log(F.col("v")) + (F.col("lam") - 1.0) * F.col("j")
    return (fit.withColumn("ll", score).where("values > 1 AND v > 0 AND v < double('infinity') AND ll < double('infinity')").groupBy("variable")
            .agg(F.max_by("lam", F.struct("ll", -F.col("lam"))).alias("lam")))


def yeo_johnson_lambdas(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, lam): the likeliest power, to 0.0025.

    The search starts with -4..4 by 0.25. Where the best value is an end of its range, the range
    goes on from there to twice that end, until the best lies inside or larger powers leave the
    doubles. Then steps a tenth as long are tried around it. A step takes one row per variable
    to the driver, never values.
    """
    long = to_long(df, [], columns).groupBy("variable", "x").agg(F.count(F.lit(1)).alias("c"))
    counts = written(long, "value-counts")

    def best(around: DataFrame, first: int, last: int) -> DataFrame:
        # one row per column name
        near = counts.join(F.broadcast(around), "variable")
        grid = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.col("_c") + i * F.col("_step"))
        return _best_lambda(near, grid)

    spark, schema = df.sparkSession, "variable string, _c double, _step double"
    steps = {c: 0.25 for c in columns}
    found = {r.variable: r.lam for r in best(
        spark.createDataFrame([(c, 0.0, s) for c, s in steps.items()], schema), -16, 16).collect()}
    ends = {c: lam for c, lam in found.items() if abs(lam) == 4.0}
    while ends:
        steps |= {c: abs(end) / 16.0 for c, end in ends.items()}
        rows = [(c, end, math.copysign(steps[c], end)) for c, end in ends.items()]
        farther = {r.variable: r.lam for r in best(spark.createDataFrame(rows, schema), 0, 16).collect()}
        found |= farther
        ends = {c: lam for c, lam in farther.items() if abs(lam) == 2.0 * abs(ends[c])}
    while found:
        coarse = {c: steps[c] for c in found if steps[c] > 0.0026}
        if not coarse:
            break
        steps |= {c: s / 10.0 for c, s in coarse.items()}
        rows = [(c, found[c], steps[c]) for c in coarse]
        found |= {r.variable: r.lam for r in best(spark.createDataFrame(rows, schema), -10, 10).collect()}
    return spark.createDataFrame(list(found.items()), "variable string, lam double")


def scale_yeojohnson(df: DataFrame, columns: list[str], prefix: str = "yeojohnson_") -> DataFrame:
    """Yeo-Johnson transform of largest likelihood, then zero mean and unit deviation."""
    lams = yeo_johnson_lambdas(df, columns)
    wide = lams.agg(*[F.max(F.when(F.col("variable") == c, F.col("lam"))).alias(f"_l_{c}") for c in columns])
    power = df.withColumn("_l", wide.select(F.struct(*wide.columns)).scalar()).withColumns({
        f"{prefix}{c}": yeo_johnson(F.col(c).cast("double"), F.coalesce(F.col(f"_l._l_{c}"), F.lit(1.0)))
        for c in columns}).drop("_l")
    names = [f"{prefix}{c}" for c in columns]
    return scale_zscore(power, names, "").select(*df.columns, *names)


def scale_quantile(df: DataFrame, columns: list[str], prefix: str = "quantile_") -> DataFrame:
    """Rank share (ties get their mean rank) mapped to the normal distribution.

    Ranks come from running totals over distinct values, not from a one-task sort.
    """
    out = df
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        total = df.agg(F.count(c)).scalar()
        ranked = running_total(counts, [], c, ["_n"])
        mid = F.col("cum__n") - F.col("_n") + (F.col("_n") - 1) / 2.0
        share = F.coalesce(F.try_divide(mid, (total - 1).cast("double")), F.lit(0.5))
        clipped = F.greatest(F.least(share, F.lit(1 - 1e-7)), F.lit(1e-7))
        table = ranked.withColumn("_p", clipped).select(
            F.col(c).alias("_v"), inverse_normal(F.col("_p")).alias(f"{prefix}{c}"))
        out = out.join(table, out[c] == table["_v"], "left").drop("_v")
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; the total is a scalar subquery."""
    total = df.agg(F.count(column)).scalar()
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def histogram(df: DataFrame, column: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over the whole range, the last one closed; empty bins are left out."""
    by = list(by or [])
    b = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    width = (b["hi"] - b["lo"]) / F.lit(float(bins))
    spot = F.floor(F.coalesce(F.try_divide(F.col(column) - b["lo"], width), F.lit(0.0)))
    placed = df.where(F.col(column).isNotNull()).select(
        *by, F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"))
    counted = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({
        "bin_start": b["lo"] + F.col("bin") * width, "bin_end": b["lo"] + (F.col("bin") + 1) * width})


def hexbin(
    df: DataFrame, value: str, x: str = "longitude", y: str = "latitude", grid: int = 50
) -> DataFrame:
    """Mean of ``value`` per hexagon: the nearer centre of two shifted lattices."""
    rows = int(grid / 3**0.5)
    b = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x9"), F.min(y).alias("y0"),
                        F.max(y).alias("y9")).alias("s")).scalar()
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull())
    df = df.withColumn("_b", b)
    sx = (F.col("_b.x9") - F.col("_b.x0")) / grid
    sy = (F.col("_b.y9") - F.col("_b.y0")) / rows
    df = df.withColumns({"_sx": sx, "_sy": sy})
    u = F.coalesce(F.try_divide(F.col(x) - F.col("_b.x0"), F.col("_sx")), F.lit(0.0))
    v = F.coalesce(F.try_divide(F.col(y) - F.col("_b.y0"), F.col("_sy")), F.lit(0.0))
    df = df.withColumns({"_u": u, "_v": v})
    u, v = F.col("_u"), F.col("_v")
    on, off = (F.rint(u), F.rint(v)), (F.floor(u) + 0.5, F.floor(v) + 0.5)

    def apart(c):
        return F.pow(u - c[0], F.lit(2.0)) + 3.0 * F.pow(v - c[1], F.lit(2.0))

    first = apart(on) < apart(off)
    placed = df.withColumns({
        "hex_x": F.when(first, on[0]).otherwise(off[0]), "hex_y": F.when(first, on[1]).otherwise(off[1])})
    return placed.groupBy("hex_x", "hex_y").agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"),
        (F.first("_b.x0") + F.col("hex_x") * F.first("_sx")).alias("center_x"),
        (F.first("_b.y0") + F.col("hex_y") * F.first("_sy")).alias("center_y"))


def boxplot_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 ranges) and number of outliers."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).drop("n")
    joined = to_long(df, [], columns).join(F.broadcast(q), "variable")  # one row per column name
    room = 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.col("x").between(F.col("q0") - room, F.col("q2") + room)
    return joined.groupBy("variable").agg(
        F.first("q0").alias("q1"), F.first("q1").alias("median"), F.first("q2").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"))


def distinct_cells(df: DataFrame, cell: str = "grid_id") -> DataFrame:
    return df.agg(F.count_distinct(cell).alias("n_grids"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts of both classes and negatives per positive."""
    n_neg, n_pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        n_neg.alias("n_negative"), n_pos.alias("n_positive"),
        F.try_divide(n_neg.cast("double"), n_pos).alias("scale_pos_weight"))


def numeric_transform(
    df: DataFrame, log_power: bool = True, scale_brightness: bool = True
) -> DataFrame:
    """log(1 + frp), and brightness mapped onto [0.1, 1.0]."""
    if log_power and "frp" in df.columns:
        df = df.withColumn("frp_log", F.log1p("frp"))
    if scale_brightness and "brightness" in df.columns:
        df = scale_minmax(df, ["brightness"], 0.1, 1.0, "_scaled_")
        df = df.withColumnRenamed("_scaled_brightness", "brightness_normalized")
    return df


def encode_objects(df: DataFrame, columns: list[str], row_key: str) -> DataFrame:
    """Text to numbers: names with ``date`` to epoch seconds, others to first-seen codes.

    Codes count categories by the smallest row key at which they occur; NULL becomes -1.
    """
    for c in columns:
        if "date" in c.lower():
            df = df.withColumn(c, F.unix_seconds(F.try_to_timestamp(F.col(c).cast("string"))))
            continue
        seen = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(
            F.min(row_key).alias("_first"), F.lit(1).alias("_one"))
        codes = running_total(seen, [], "_first", ["_one"]).select(
            "_v", (F.col("cum__one") - 1).alias("_code"))
        order = df.columns
        df = df.join(codes, F.col(c) == F.col("_v"), "left").withColumn(
            c, F.coalesce(F.col("_code"), F.lit(-1))).select(*order)
    return df


