"""Time expressions. All work in whole seconds since the epoch, zone UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_time(text) -> Column:
    return F.to_timestamp(_col(text))


def epoch_seconds(time) -> Column:
    """Floor of the time in seconds."""
    return F.floor(F.unix_micros(_col(time)) / 1_000_000).cast("long")


def ceil_to_bucket(time, seconds: int) -> Column:
    """End of the bucket that holds the time; a time on a border keeps its value."""
    width = seconds * 1_000_000
    return F.timestamp_seconds((F.ceil(F.unix_micros(_col(time)) / width) * seconds).cast("long"))


def hour_of_day(time) -> Column:
    return F.hour(_col(time))


def day_of_week(time) -> Column:
    """Monday is 0."""
    return F.weekday(_col(time))
