"""Calendar buckets as plain expressions, so that they work on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import SIZED_UNITS, UNITS, QueryError


def bucket_start(ts: Column, unit: str, size: int | None = None) -> Column:
    """The start of the bucket that holds a time: a calendar unit, or a number of them within the next larger one."""
    if unit in UNITS:
        return F.date_trunc(unit, ts)
    if unit not in SIZED_UNITS:
        raise QueryError(f"unknown unit {unit}")
    if not isinstance(size, int) or isinstance(size, bool) or size < 1:
        raise QueryError(f"{unit} need a whole size of 1 or more")
    n = F.lit(size)
    if unit == "years":
        return F.make_timestamp((F.floor(F.year(ts) / n) * n).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if unit == "months":
        return F.make_timestamp(F.year(ts), (F.floor((F.month(ts) - 1) / n) * n + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    part, base = {"hours": (F.hour(ts), "day"), "minutes": (F.minute(ts), "hour"), "seconds": (F.second(ts), "minute")}[unit]
    step = {"hours": 3600, "minutes": 60, "seconds": 1}[unit]
    return F.timestamp_seconds(F.unix_seconds(F.date_trunc(base, ts)) + (F.floor(part / n) * n * step).cast("long"))


def bucket_millis(ts: Column, unit: str, size: int | None = None) -> Column:
    return F.unix_millis(bucket_start(ts, unit, size))
