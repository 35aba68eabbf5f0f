"""Columns on instants. None reads a clock: the time of a run is an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_time(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def compact(ts: Column) -> Column:
    """20240131T235959Z, in a session of UTC."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def lenient_timestamp(text: Column) -> Column:
    """ISO 8601, or null."""
    return F.try_to_timestamp(text)


def iso_date(text: Column) -> Column:
    """The first ten characters of a stated date, null if there are none."""
    return F.nullif(F.left(text, F.lit(10)), F.lit(""))


def older_than(ts: Column, now: Column, hours: float) -> Column:
    return F.unix_micros(now) - F.unix_micros(ts) >= F.lit(int(hours * 3_600_000_000))
