"""Rows that hold from one day to another, met with days without being expanded into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_DAYS = 31


def bucketed(intervals: DataFrame, start: str, end: str, days: int = BUCKET_DAYS) -> DataFrame:
    """One row for each run of days that an interval touches, with its number as ``__bucket``."""
    first, last = (F.floor(F.col(c) / days) for c in (start, end))
    return intervals.withColumn("__bucket", F.explode(F.sequence(first, last)))


def on_days(
    intervals: DataFrame, days: DataFrame, day: str, start: str, end: str, bucket_days: int = BUCKET_DAYS
) -> DataFrame:
    """Every interval with every day inside it; both ends included.

    A range join would compare each interval with each day. Both are given the runs of days they
    touch, and meet on equal runs: an interval has a row per run, and a run has as many days as
    ``days`` names in it. An interval that ends before it starts meets nothing.
    """
    held = bucketed(intervals.where(F.col(start) <= F.col(end)), start, end, bucket_days)
    asked = days.withColumn("__run", F.floor(F.col(day) / bucket_days))
    inside = (F.col("__bucket") == F.col("__run")) & F.col(day).between(F.col(start), F.col(end))
    return held.join(asked, inside).drop("__bucket", "__run")
