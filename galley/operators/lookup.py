"""Joins of the star schema: lookups, orphans, drill-across.

No join here carries a broadcast hint. Dimensions are read from written tables, so Spark
knows their size: it broadcasts those under ``spark.sql.autoBroadcastJoinThreshold`` and
shuffles the others, splitting hot partitions at run time (AQE skew join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Lookup:
    """Fetch ``take`` (dimension column -> output name) where ``fact_key = dim_key``."""

    dim: DataFrame
    fact_key: str
    dim_key: str
    take: Mapping[str, str] = field(default_factory=dict)
    # Column whose hash spreads fact rows with a null key, where many are expected.
    spread_nulls_by: str | None = None


def left_lookup(fact: DataFrame, look: Lookup) -> DataFrame:
    """Left join to a dimension that is unique on its key; keeps every fact row once.

    Rows with a null key match nothing, but a plain shuffle join would send all of them
    to one partition. With ``spread_nulls_by`` a hash of that column stands in for the key, so
    they spread over all partitions, however many there are.
    The real equality stays in the join condition, so a stand-in can never match.
    """
    picked = look.dim.select(
        F.col(look.dim_key).alias("__key"), *[F.col(c).alias(a) for c, a in look.take.items()]
    )
    condition = fact[look.fact_key] == picked["__key"]
    if look.spread_nulls_by:
        kind = fact.schema[look.fact_key].dataType
        narrow = isinstance(kind, T.IntegerType)  # a 64-bit hash does not fit
        hashed = (F.hash if narrow else F.xxhash64)(fact[look.spread_nulls_by])
        stand_in = F.coalesce(fact[look.fact_key], hashed.cast(kind))
        condition = (stand_in == picked["__key"]) & condition
    return fact.join(picked, condition, "left").drop("__key")


def star_lookup(fact: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    return reduce(left_lookup, lookups, fact)


def orphan_rows(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Fact rows with a key the dimension does not have. Null keys are not orphans."""
    keys = dim.select(F.col(pk).alias("__pk"))
    present = fact.where(F.col(fk).isNotNull())
    return present.join(keys, present[fk] == keys["__pk"], "left_anti")


def orphan_keys(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """(key, rows) of every key the dimension lacks.

    The fact is counted per key first, with map-side combining, so the anti-join sees one
    row per key however often a hot key occurs.
    """
    counted = fact.groupBy(F.col(fk).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return orphan_rows(counted, "key", dim, pk)


def joined_rows(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """One row ``(before, after)``: rows of the fact, and rows of a left join on the key.

    Shows whether a lookup on a key that may repeat in the dimension multiplies rows. The
    pairs are not formed: both sides are counted per key and the counts are multiplied.
    """
    left = fact.groupBy(F.col(fk).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    right = dim.groupBy(F.col(pk).alias("__pk")).agg(F.count(F.lit(1)).alias("matches"))
    both = left.join(right, F.col("key") == F.col("__pk"), "left")
    total = F.col("rows") * F.coalesce(F.col("matches"), F.lit(1))
    return both.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("before"),
        F.coalesce(F.sum(total), F.lit(0)).alias("after"),
    )


def drill_across(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of aggregates on shared, possibly null, keys."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
        condition: Column = reduce(lambda a, b: a & b, same)
        joined = left.join(renamed, condition, "full")
        merged = [F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in keys]
        rest = [c for c in left.columns + right.columns if c not in keys]
        return joined.select(*merged, *rest)

    if not keys:
        raise ValueError("drill_across needs at least one shared key")
    return reduce(merge, frames)


def summary_per_parent(
    parent: DataFrame,
    child: DataFrame,
    on: tuple[str, str],
    keep: Sequence[str],
    aggs: Mapping[str, Column],
    zero: Sequence[str] = (),
) -> DataFrame:
    """Aggregates of a child table per row of a parent table with a unique key.

    The child is aggregated before the join, so a parent with very many children costs one
    row per map task in the shuffle. Parents without children stay: the aggregates named in
    ``zero`` (counts) are 0 for them, the others null, as in a left join followed by a group.
    """
    parent_key, child_key = on
    rolled = child.groupBy(F.col(child_key).alias("__key")).agg(
        *[agg.alias(name) for name, agg in aggs.items()]
    )
    joined = parent.select(*keep).join(rolled, F.col(parent_key) == F.col("__key"), "left")
    return joined.drop("__key").fillna(0, subset=list(zero)) if zero else joined.drop("__key")
