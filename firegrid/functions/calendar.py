"""Week and season columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(c) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


def week_start(c) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", _date(c)))


def week_text(c) -> Column:
    """Monday-to-Sunday period as ``2012-12-31/2013-01-06``."""
    start = week_start(c)
    return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))


def week_text_start(c) -> Column:
    """Monday of a period in text form; unreadable text gives NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(F.substring_index(c, "/", 1), F.lit("yyyy-MM-dd")))


def mid_week(start) -> Column:
    """The day three days after the Monday (kept as published, although that is a Thursday)."""
    return F.date_add(F.col(start) if isinstance(start, str) else start, 3)


def date_from_name(name, pattern: str = r"^(\d{8})\.csv$", fmt: str = "yyyyMMdd") -> Column:
    """Date in a file name such as ``20130105.csv``; other names give NULL."""
    name = F.col(name) if isinstance(name, str) else name
    return F.to_date(F.try_to_timestamp(F.regexp_extract(name, pattern, 1), F.lit(fmt)))


def cycle(value, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of the given period."""
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
