"""Deduplication and surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.columns import prefixed_id
from galley.session import scratch_path

# Groups by hash in which ``distinct_on_ids`` counts rows, and the rows that make one crowded.
HASH_GROUPS = 1 << 16
HOT_ROWS = 100_000


def _tie_break(df: DataFrame, used: set[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in df.columns if c not in used]


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str] = ()
) -> DataFrame:
    """One row per key: the first by ``order_by``.

    Ties are broken by all remaining columns, ascending with nulls first, so the survivor
    does not depend on how the input is partitioned. Spark turns ``row_number() = 1`` into
    a group limit that runs before the shuffle too: every map task forwards one row per
    key, and a key that holds a third of the input does not fill one reducer.

    The groups are sorted by a hash of the key before the key itself. Ids such as
    'EVT000000000123' agree in their first eight bytes, which is all that Spark's sort
    compares without looking at the row; a hash tells them apart there.
    """
    order = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order_by]
    groups = Window.partitionBy(F.xxhash64(*keys), *keys)
    window = groups.orderBy(*order, *_tie_break(df, set(keys)))
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .where(F.col("__rank") == 1)
        .drop("__rank")
    )


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dropDuplicates(keys)`` with a defined survivor (the smallest row)."""
    return first_per_key(df, keys)


def distinct_on_ids(df: DataFrame, key: str) -> DataFrame:
    """``distinct_on`` for a table whose ids are expected to be unique, or nearly so.

    Every row moves once, as it is read, and is sorted where it arrives. Sorting before the shuffle,
    as ``first_per_key`` has it, would drop next to nothing here and spill where input files are
    dense. It is kept for ids with very many copies, which would fill one reducer: rows are counted
    by a hash of ``HASH_GROUPS`` values, and groups of more than ``HOT_ROWS`` rows take that way
    (of billions of rows all do). The counts have a fixed size, and so has the broadcast of the
    groups, whatever the table: the plan, and what a row costs, is the same at every size.

    The table is read three times, so it should be a written one.
    """
    tagged = df.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(HASH_GROUPS)).cast("int"))
    crowded = (
        tagged.groupBy(F.col("__group").alias("__hot"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > HOT_ROWS)
        .select("__hot")
    )
    same = F.col("__group") == F.col("__hot")
    few = tagged.join(F.broadcast(crowded), same, "left_anti").drop("__group")
    many = tagged.join(F.broadcast(crowded), same, "left_semi").drop("__group")
    return distinct_on(few.repartition(F.col(key)), [key]).unionByName(distinct_on(many, [key]))


def with_row_id(df: DataFrame, source: str, name: str, prefix: str, width: int = 12) -> DataFrame:
    """Text id from a dense number the row already has (``spark.range`` or a key)."""
    return df.withColumn(name, prefixed_id(prefix, F.col(source), width))


def number_ids(
    ids: DataFrame, column: str, name: str, key_type: str = "int", partitions: int | None = None
) -> DataFrame:
    """``(column, name)``: the distinct values of a column numbered 1..n in their order.

    1. Range-partition and sort the distinct values, so partition p holds smaller values than
       partition p + 1, and tag each with its partition and its position in it.
    2. Write the tagged values, and nothing else, to the shared scratch folder. Range bounds are
       sampled, so a recomputed plan could cut elsewhere; the written table pins the cut for
       both reads below and cuts the lineage.
    3. Count values per partition (reads the tag column only), add up the counts of earlier
       partitions, and join the offsets back.

    The offset table has one row per shuffle partition, whatever the size of the input;
    that is why it may use a global window and a broadcast. The default key type is the
    32-bit integer of the gold contract. More than two billion values do not fit (under ANSI
    that is an error, not a wrong key); such tables take ``key_type="bigint"``.
    """
    spark = ids.sparkSession
    by = F.col(column).asc_nulls_first()
    distinct = ids.select(column).distinct()
    ranged = (
        distinct.repartitionByRange(partitions, by) if partitions else distinct.repartitionByRange(by)
    ).sortWithinPartitions(by)
    # monotonically_increasing_id() is partition << 33 | position within the partition.
    tagged = ranged.withColumn("__tag", F.monotonically_increasing_id()).select(
        column,
        F.shiftright(F.col("__tag"), 33).cast("int").alias("__part"),
        F.col("__tag").bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"),
    )
    path = scratch_path(spark, f"ids-{name}")
    tagged.write.parquet(path)
    pinned = spark.read.schema(tagged.schema).parquet(path)

    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pinned.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            "__part",
            F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
        )
    )
    return pinned.join(F.broadcast(offsets), "__part").select(
        column, (F.col("__offset") + F.col("__pos") + 1).cast(key_type).alias(name)
    )


def dense_key(
    df: DataFrame,
    order_by: str,
    name: str,
    key_type: str = "int",
    partitions: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """1..n by a unique column, for tables of any size.

    Only the column itself is sorted and pinned (``number_ids``); the numbers are then joined to
    the rows, which move once. ``ids`` may name a cheaper source of the same values, such as the
    table before it was deduplicated.
    """
    numbers = number_ids(df if ids is None else ids, order_by, name, key_type, partitions)
    renamed = numbers.withColumnRenamed(order_by, "__id")
    return df.join(renamed, F.col(order_by).eqNullSafe(F.col("__id"))).drop("__id")
