"""Refreshing facts: only the months whose source rows have changed are built and written again.

A ledger keeps, for every month of a fact, the number and a checksum of the silver rows it was built
from. A refresh compares it with the silver table as it is now (one scan, one row per month moves)
and replaces the partitions of the months that differ; all others keep their files. Keys must be
those of the run before: use a ``KeyRegistry``, or dimensions that have not changed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.gold import with_month
from galley.sources.catalog import exists, read_table, replace_partitions, write_table

MONTH = "date_month"


def month_of(day: str) -> Column:
    return (F.year(day) * 100 + F.month(day)).alias(MONTH)


def ledger_table(fact: str) -> str:
    return f"months_{fact}"


def month_sums(rows: DataFrame, day: str, ignore: tuple[str, ...] = ("load_timestamp",)) -> DataFrame:
    """``(date_month, rows, checksum)``. The checksum does not depend on the order of rows and,
    unlike an exclusive or, sees rows that are there twice."""
    columns = sorted(c for c in rows.columns if c not in ignore)
    mark = F.xxhash64(*columns)
    return rows.groupBy(month_of(day)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(mark.cast("decimal(20,0)")).cast("string").alias("checksum")
    )


def changed_months(now: DataFrame, before: DataFrame) -> DataFrame:
    """Months of either side whose sums differ or that the other side lacks."""
    old = before.select(F.col(MONTH).alias("__month"), F.col("rows").alias("__rows"), F.col("checksum").alias("__sum"))
    both = now.join(old, F.col(MONTH).eqNullSafe(F.col("__month")), "full")
    same = F.col("rows").eqNullSafe(F.col("__rows")) & F.col("checksum").eqNullSafe(F.col("__sum"))
    gone = F.col("rows").isNull()
    return both.where(~same).select(F.when(gone, F.col("__month")).otherwise(F.col(MONTH)).alias(MONTH), gone.alias("gone"))


def refresh_fact(
    spark: SparkSession,
    source: DataFrame,
    day: str,
    build: Callable[[DataFrame], DataFrame],
    layer: str,
    fact: str,
    calendar_start: date,
    fmt: str = "parquet",
) -> list[int | None]:
    """Brings a fact up to date with ``source``; returns the months that were written.

    ``build`` makes fact rows of source rows. The first call builds everything. The list of changed
    months (a row per month) is what the driver sees. A month that has lost all its rows is
    overwritten with none: then the whole fact is written again, as no row names its partition.
    """
    now = month_sums(source, day)
    first = not (exists(spark, layer, fact) and exists(spark, layer, ledger_table(fact)))
    if first:
        months, everything = [r[MONTH] for r in now.select(MONTH).collect()], True
    else:
        changed = changed_months(now, read_table(spark, layer, ledger_table(fact))).collect()
        months, everything = [r[MONTH] for r in changed], any(r.gone for r in changed)
    layout = {"partition_by": [MONTH], "cluster_by": ["date_key"]}
    if everything:
        write_table(with_month(build(source), calendar_start), layer, fact, fmt, overwrite_schema=True, **layout)
    elif months:
        wanted = month_of(day).isin([m for m in months if m is not None])
        if None in months:
            wanted = wanted | F.col(day).isNull()
        replace_partitions(with_month(build(source.where(wanted)), calendar_start), layer, fact, **layout)
    if everything or months:
        # after the fact: a refresh that stops before this finds the same months changed again
        write_table(now, layer, ledger_table(fact), fmt)
    return sorted(months, key=lambda m: (m is not None, m))
