"""Distinct counts that add up: sets of dense integer keys as bitmaps.

A key is one bit of one bucket (32,768 keys each). Bitmaps of the same bucket are OR-ed, so the
distinct keys of any union of groups follow from stored bitmaps, exactly, without the rows.
Dense keys (``dense_key``) fill their buckets; null keys are in no set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "bucket", "bits"


def key_bitmaps(df: DataFrame, key: Column, by: Sequence[str]) -> DataFrame:
    """``(by, bucket, bits)``: the keys of each group.

    A group whose keys are all null keeps one row without bucket and bits set, so that it is
    counted as 0 later instead of missing. Bits are set map-side: what is shuffled is a bitmap
    per group, bucket and task.
    """
    value = key.cast("long")
    return df.groupBy(*by, F.bitmap_bucket_number(value).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias(BITS)
    )


def merged(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bitmaps of larger groups: the union of the sets of all that fall together."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def counted(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct keys of each group; with no ``by``, one row in total."""
    sizes = merged(bitmaps, by).withColumn("__n", F.bitmap_count(BITS))
    n = F.coalesce(F.sum("__n"), F.lit(0)).alias(name)
    return sizes.groupBy(*by).agg(n) if by else sizes.agg(n)


def counted_sets(bitmaps: DataFrame, sets: Sequence[Sequence[str]], name: str) -> DataFrame:
    """Distinct keys of several groupings at once, with ``grouping_id``; absent columns are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    # the bucket belongs to every set: it is a column of the grouping, not of the result
    united = (
        bitmaps.groupingSets([[*[F.col(c) for c in s], F.col(BUCKET)] for s in sets], *columns, BUCKET)
        .agg(F.bitmap_or_agg(BITS).alias(BITS), F.shiftright(F.grouping_id(), 1).alias("level"))
        .withColumn("__n", F.bitmap_count(BITS))
    )
    return united.groupBy(*columns, "level").agg(F.sum("__n").alias(name))
