"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: list[str] = []

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM interprets methods above this size; a stage with one (dozens of columns) is better run without fused code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Dynamic overwrite lets a re-run replace only the partitions it produced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(app: str = "firegrid", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session; shuffle partitions are left to the cluster and AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="firegrid-"))
    return _local_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """Write ``df`` to the shared folder and read it back: lineage ends at a durable table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
