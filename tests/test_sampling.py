import datetime as dt

import pytest
from pyspark.sql import functions as F

from firegrid.functions.calendar import week_text
from firegrid.operators import sampling as s


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(50).select(F.concat(F.lit("11S_"), (F.col("id") + 200).cast("string"), F.lit("_3800")).alias("grid_id"))


@pytest.fixture(scope="module")
def positives(spark):
    rows = [(f"11S_{200 + k % 50}_3800", dt.date(2022, 1, 3) + dt.timedelta((k * 5) % 140)) for k in range(300)]
    df = spark.createDataFrame(rows, "grid_id string, acq_date date")
    return df.withColumns({
        "week": week_text("acq_date"), "latitude": F.lit(34.0), "longitude": F.lit(-118.0),
        "frp_log": F.lit(1.0), "brightness_normalized": F.lit(0.5)})


@pytest.mark.parametrize("n", [10, 300, 10_000])
def test_negatives(positives, cells, n):
    neg = s.negative_samples(positives, cells, n).toPandas()
    known = set(map(tuple, positives.select("grid_id", "week").distinct().toPandas().to_numpy()))
    pairs = set(zip(neg.grid_id, neg.week))
    free = 50 * 20 - len(known)
    assert len(neg) == len(pairs) == min(n, free)
    assert not pairs & known
    assert (neg.fire == 0).all() and neg.latitude.notna().all()


def test_negatives_repeat(positives, cells):
    a = s.negative_samples(positives, cells, 40, 1).toPandas()
    b = s.negative_samples(positives.repartition(5), cells.repartition(3), 40, 1).toPandas()
    c = s.negative_samples(positives, cells, 40, 2).toPandas()
    key = lambda d: set(zip(d.grid_id, d.week))
    assert key(a) == key(b) != key(c)


def test_full_and_sampled(positives, cells):
    full = s.full_dataset(positives, s.negative_samples(positives, cells, 200))
    assert {r.fire: r["count"] for r in full.groupBy("fire").count().collect()} == {1: 300, 0: 200}
    key = F.concat_ws("|", "grid_id", "week")
    for total, want in ((350, 50), (100, 0), (9999, 200)):
        got = {r.fire: r["count"] for r in s.sample_dataset(full, total, key).groupBy("fire").count().collect()}
        assert got == ({1: 300, 0: want} if want else {1: 300})


def test_weeks(spark):
    df = spark.createDataFrame([(dt.date(2013, 1, 1),), (dt.date(2013, 1, 20),)], "acq_date date")
    assert sorted(r.week for r in s.all_weeks(df).collect()) == [
        "2012-12-31/2013-01-06", "2013-01-07/2013-01-13", "2013-01-14/2013-01-20"]


def test_sample_split_folds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    assert s.sample_rows(df, 17, "id").count() == 17
    parts = {(r.label, r.part): r["count"] for r in s.stratified_split(df, "id").groupBy("label", "part").count().collect()}
    assert parts == {(0, "test"): 180, (0, "val"): 180, (0, "train"): 540, (1, "test"): 20, (1, "val"): 20, (1, "train"): 60}
    folds = s.stratified_folds(df, "id").groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in folds} == {(0, 180), (1, 20)} and len(folds) == 10
