"""Registry of runnable queries and of the SQL that must give the same rows.

A query states its output columns once; the same statement shapes the Spark result and the
SQL text: ``name`` as it is, ``name:r`` a double rounded to 6 places, ``name:i`` a 64-bit
integer, ``name:d`` a date as text. ``name:a`` is a mean: a mean of 2**k short decimals can lie
exactly half-way between two 6-place numbers, where engines round to different sides, so
both sides shift it by 1e-9 before rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.plans.adapters import SQL, Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    columns: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} exists")
        REGISTRY[name] = Query(fn, columns, sql)
        return fn
    return add


def _split(columns: str) -> list[tuple[str, str]]:
    return [tuple((c.split(":") + [""])[:2]) for c in columns.split()]


def six_places(x: Column) -> Column:
    """``round(x, 6)`` of a double. Spark rounds the decimal text of every value; that is left to values near a half, large ones and non-numbers."""
    scaled = x * 1e6
    down = F.floor(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - down - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(F.round(x, 6))


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _split(columns):
        c = F.col(name)
        if kind == "r":
            c = six_places(c.cast("double")) + 0.0
        elif kind == "a":
            c = six_places(c.cast("double") + 1e-9) + 0.0
        elif kind == "i":
            c = c.cast("long")
        elif kind == "d":
            c = F.to_date(c).cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(body: str, columns: str) -> str:
    forms = {"r": "ROUND(CAST({0} AS DOUBLE), 6) + 0e0", "i": "CAST({0} AS BIGINT)",
             "a": "ROUND(CAST({0} AS DOUBLE) + 1e-9, 6) + 0e0",
             "d": "CAST(CAST({0} AS DATE) AS VARCHAR)", "": "{0}"}
    picked = ", ".join(f"{forms[k].format(n)} AS {n}" for n, k in _split(columns))
    views = ", ".join(f"{v} AS ({text})" for v, text in SQL.items() if v in body)
    return (f"WITH {views} " if views else "") + f"SELECT {picked} FROM ({body}) AS result"


def load() -> dict[str, Query]:
    """Import the query modules, which fill the registry."""
    from firegrid.plans import (  # noqa: F401
        q_cleaning, q_evaluation, q_files, q_joins, q_models, q_profiling, q_sampling, q_scalars,
        q_weather)
    return REGISTRY


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: shape(q.run(Tables(spark, folder)), q.columns)
    return {name: bind(q) for name, q in load().items()}


def oracle_texts() -> dict[str, str]:
    return {name: shape_sql(q.sql, q.columns) for name, q in load().items() if q.sql}
