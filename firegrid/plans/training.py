"""The three end-to-end flows: detections to labels, weather to matches, training to scores.

Each flow is one lazy plan per stored table. Stages that are read several times are written
to the folder the caller names, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.functions.spatial import with_cell
from firegrid.operators import cleaning, evaluation, joins, modelling, profiling, sampling, weather
from firegrid.operators.polygons import lattice_cells, within_polygon
from firegrid.session import written
from firegrid.sources import files


def clean_fires(raw: DataFrame, edges: DataFrame) -> DataFrame:
    """Complete, distinct detections inside the outline."""
    rows = cleaning.drop_duplicate_rows(cleaning.drop_null_rows(raw))
    return within_polygon(cleaning.in_coordinate_range(cleaning.valid_coordinates(rows)), edges)


def label_fires(
    clean: DataFrame, edges: DataFrame, n_negatives: int, total: int, seed: int = 42,
    size_km: float = 1, drop_low: bool = True,
) -> DataFrame:
    """Positives with cell and week, plus sampled negatives, cut to ``total`` rows.

    Brightness is scaled before the type filter, as published.
    """
    fires = with_cell(clean, size_km).withColumn("week", week_text("acq_date"))
    fires = cleaning.confidence_filter(fires, drop_low)
    fires = cleaning.vegetation_fires(profiling.numeric_transform(fires))
    fires = cleaning.repair_columns(cleaning.drop_columns(fires))
    cells = lattice_cells(clean.sparkSession, edges, size_km)
    negatives = sampling.negative_samples(fires, cells, n_negatives, seed, size_km=size_km)
    full = sampling.full_dataset(fires, negatives)
    return sampling.sample_dataset(full, total, F.concat_ws("|", "grid_id", "week"), seed)


def build_weather(
    daily: DataFrame, master_path: str, features_path: str, opts: weather.Features = weather.Features(),
    size_km: float = 1, merge_only: bool = False,
) -> DataFrame:
    """Clean the years that the master does not hold yet, store them, store and return all features.

    Cleaning works by day, so finished years stay as they are; features look at the whole
    master, as bins and quartiles span years. ``merge_only`` builds features from the master as it is.

    Distinct rows of one location and day are an error: their order inside the day windows
    would be open. The caller decides how to reduce them (``cleaning.one_row_per_day`` is one way).
    """
    if not merge_only:
        files.write_new_years(daily, master_path, size_km, cleaning.clean_weather)
    master = daily.sparkSession.read.option("mergeSchema", True).parquet(master_path)  # a year may lack a sparse column
    repeated = master.groupBy("longitude", "latitude", "date").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("several rows for one location and day: reduce them before building features")
    features = weather.engineer_features(master, opts)
    features = features.withColumn("year", F.year("date"))
    features.write.mode("overwrite").partitionBy("year", "month").parquet(features_path)
    return daily.sparkSession.read.parquet(features_path)


def train_and_evaluate(
    table: DataFrame, features: list[str], key: str, label: str = "fire", params: dict | None = None,
    seed: int = 42,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, scored rows with ``part``, one-row metrics of test, train and validation)."""
    present, _ = cleaning.feature_list(table, features)
    parts = sampling.stratified_split(table.select(key, label, *present), key, label, seed=seed)
    fitted = parts.where(F.col("part") != "test").withColumn("_val", F.col("part") == "val")
    model = modelling.train(fitted, present, label, params, validation="_val")
    scored = written(modelling.score(parts, model), "scored")
    metrics = evaluation.overfit_gaps(scored, split="part", label=label, score="fire_probability")
    return model, scored, metrics


def match(fires: DataFrame, features: DataFrame, days: int = 1) -> DataFrame:
    """Fires with the weather features of their nearest station and day."""
    return joins.merge_fire_weather(fires, features, days)
