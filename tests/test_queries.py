"""Every query against its SQL on the smallest tables, and properties of the plans."""

import glob
import os
import re

import duckdb
import pytest

from check import canonical
from firegrid.plans.catalog import load, oracle_texts, spark_queries

FOLDER = "/root/testdata/sf0.001"
ORACLE = oracle_texts()
QUERIES = spark_queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan and "BatchEvalPython" not in plan
    got = df.toPandas()
    assert len(got) > 0 and not got.isna().all(axis=None)
    if name in ORACLE:
        assert canonical(got) == canonical(db.execute(ORACLE[name]).df())


def test_all_operators_are_registered():
    assert len(load()) == 121
    assert set(load()) == set(ORACLE)


def test_features_shuffle_rows_once(spark):
    from firegrid.operators.weather import Features, engineer_features
    from firegrid.plans.adapters import Tables
    weather = Tables(spark, FOLDER).weather()
    df = engineer_features(weather, Features(vpd=False, scaled=False, chunk_days=None))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*longitude", plan)) == 1


def test_location_table_needs_no_shuffle_by_location(spark, tmp_path):
    from firegrid.operators.weather import Features, engineer_features
    from firegrid.plans.adapters import Tables
    from firegrid.sources.files import open_location_table, write_location_table
    weather, path = Tables(spark, FOLDER).weather(), str(tmp_path / "rows")
    write_location_table(weather, "by_location", path, 4)
    spark.sql("DROP TABLE by_location")  # its files stay
    again = open_location_table(spark, weather.schema, "by_location_again", path, 4)
    assert len(glob.glob(f"{path}/*.parquet")) <= 4
    assert again.count() == weather.count() and again.drop("location_key").exceptAll(weather).isEmpty()
    for opts in (Features(scaled=False), Features(vpd=False, scaled=False, chunk_days=None)):
        df = engineer_features(again, opts)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not re.search(r"Exchange hashpartitioning\([^\n]*(longitude|location_key)", plan)
        assert df.count() == weather.count()
    spark.sql("DROP TABLE by_location_again")
