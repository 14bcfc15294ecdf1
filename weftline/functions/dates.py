"""Dates out of time stamps and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def parse_moment(text: Column, pattern: str | None = None) -> Column:
    """Text to a time stamp without zone; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
