"""Stored roll-ups of the facts, and the choice of one that can answer a question.

Per fact there is one table of sums with several levels (a set of keys each), the coarser ones made
in one ``GROUPING SETS`` pass over the finest of them, and for facts with a distinct measure one table of
bitmaps. Both are keyed by month, so they answer whatever asks for whole months:

* every grouping by, and filter on, a dimension whose key a level has;
* date attributes that are the same for all days of a month; date filters that keep or drop
  months as a whole (this is looked up in the calendar, which has a row per day).

The smallest level that covers a question answers it; a question no level covers goes to the
fact. The tables are partitioned by level, so the other levels are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import bitmaps
from galley.plans import measures
from galley.plans.measures import MEASURES, RELATIONSHIPS, StarModel
from galley.sources.catalog import Layers, read_table, write_table

MONTH = "date_month"
MONTH_COLUMNS = ("year", "quarter", "month", "month_name")

# Keys of the levels. The first level of a fact holds the keys of all others that need its rows.
LEVELS: dict[str, tuple[tuple[str, ...], ...]] = {
    "fct_engagement": (
        (MONTH, "brand_key", "content_key", "platform_key"),
        (MONTH, "brand_key", "platform_key"),
        (MONTH, "content_key"),
        (MONTH, "brand_key"),
        (MONTH,),
        ("brand_key",),
        (),
    ),
    "fct_subscription": ((MONTH, "brand_key"), (MONTH,), ("brand_key",), ()),
    "fct_ad": (
        (MONTH, "brand_key", "campaign_key", "platform_key"),
        (MONTH, "brand_key", "platform_key"),
        (MONTH, "campaign_key"),
        ("campaign_key",),
        (MONTH, "brand_key"),
        (MONTH,),
        (),
    ),
}
# Keys that distinct measures can be grouped and filtered by.
BITMAP_KEYS: dict[str, tuple[str, ...]] = {
    "fct_engagement": (MONTH, "brand_key", "platform_key"),
    "fct_subscription": (MONTH, "brand_key"),
}


def _sums(fact: str) -> dict[str, measures.Base]:
    """Additive bases of a fact."""
    found = {n: m.base for n, m in MEASURES.items() if m.base and m.base.fact == fact}
    return {n: b for n, b in found.items() if b.kind != "distinct"}


def _distinct(fact: str) -> str:
    """The distinct base of a fact."""
    return next(n for n, m in MEASURES.items() if m.base and m.base.fact == fact and m.base.kind == "distinct")


def sums_table(fact: str) -> str:
    return fact.replace("fct_", "agg_")


def bitmap_table(fact: str) -> str:
    return fact.replace("fct_", "set_")


def rolled_up(rows: DataFrame, fact: str) -> DataFrame:
    """``(level, keys, rows, sums)``: all levels of a fact. A level is its place in ``LEVELS``.

    The finest level is the first aggregate itself. Only the others are expanded from it: it may
    have nearly as many groups as the fact has rows, which need not be grouped and moved again.
    """
    levels, sums = LEVELS[fact], _sums(fact)
    finest = rows.groupBy(*levels[0]).agg(
        F.count(F.lit(1)).alias("rows"), *[b.aggregate().alias(n) for n, b in sums.items()]
    )
    # grouping_id has a bit for every key of the finest level that a level lacks
    width = len(levels[0])
    lacks = {sum(1 << (width - 1 - i) for i, k in enumerate(levels[0]) if k not in level): n for n, level in enumerate(levels)}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in lacks.items() for x in pair]), F.grouping_id().cast("int"))
    coarser = (
        finest.groupingSets([[F.col(k) for k in level] for level in levels[1:]], *levels[0])
        .agg(*[F.sum(c).alias(c) for c in ("rows", *sums)], number.alias("level"))
    )
    # sums of sums are wider decimals; all levels share their type
    first = finest.withColumn("level", F.lit(0)).select(
        *[F.col(f.name).cast(f.dataType) for f in coarser.schema.fields]
    )
    return first.unionByName(coarser)


def month_bitmaps(rows: DataFrame, fact: str) -> DataFrame:
    return bitmaps.key_bitmaps(rows, MEASURES[_distinct(fact)].base.row_value(), BITMAP_KEYS[fact])


@dataclass(frozen=True)
class Rollups:
    """Stored tables by fact, and the number of rows of each level of the sums."""

    sums: Mapping[str, DataFrame]
    sets: Mapping[str, DataFrame]
    sizes: Mapping[tuple[str, int], int]

    def level_for(self, fact: str, keys: set[str]) -> int | None:
        """The smallest level that has these keys."""
        covering = [n for n, level in enumerate(LEVELS[fact]) if keys <= set(level)]
        return min(covering, key=lambda n: self.sizes.get((fact, n), 0), default=None)

    def answer(
        self,
        model: StarModel,
        fact: str,
        bases: Sequence[str],
        by: Sequence[tuple[str, str]],
        where: Mapping[str, Column],
        period: tuple[date, date] | None,
    ) -> DataFrame | None:
        """The aggregate from stored tables, or None if they do not cover it."""
        if fact in where or any(t == "dim_date" and c not in MONTH_COLUMNS for t, c in by):
            return None
        months = _whole_months(model, where.get("dim_date"), period)
        if months is None:
            return None
        dims = {t for t, _ in by} | set(where)
        keys = {MONTH if d == "dim_date" else RELATIONSHIPS[fact][d] for d in dims} | ({MONTH} if months else set())
        distinct = MEASURES[bases[0]].base.kind == "distinct"
        if distinct:
            if not keys <= set(BITMAP_KEYS.get(fact, ())):
                return None
            rows = self.sets[fact]
        else:
            level = self.level_for(fact, keys)
            if level is None:
                return None
            rows = self.sums[fact].where(F.col("level") == level)
        if months:
            rows = rows.where(_any_month(months))
        for dim, condition in where.items():
            if dim != "dim_date":
                key = RELATIONSHIPS[fact][dim]
                rows = rows.join(model.tables[dim].where(condition).select(key), key, "left_semi")
        attributes = [c for _, c in by]
        if not distinct:
            # as few rows as the keys have combinations, before they meet the dimensions
            own = [MONTH if d == "dim_date" else RELATIONSHIPS[fact][d] for d in dict.fromkeys(t for t, _ in by)]
            final = [F.sum(f"__{b}").alias(f"__{b}") for b in bases]
            rows = rows.groupBy(*own).agg(*[F.sum(b).alias(f"__{b}") for b in bases])
        for dim in dict.fromkeys(t for t, _ in by):
            columns = [c for t, c in by if t == dim]
            key = MONTH if dim == "dim_date" else RELATIONSHIPS[fact][dim]
            table = _months(model) if dim == "dim_date" else model.tables[dim]
            rows = rows.join(table.select(key, *columns).distinct(), key, "left")
        if distinct:
            return bitmaps.counted(rows, attributes, f"__{bases[0]}")
        return rows.groupBy(*attributes).agg(*final) if attributes else rows


def _months(model: StarModel) -> DataFrame:
    return model.tables["dim_date"].withColumn(MONTH, F.col("year") * 100 + F.col("month"))


def _any_month(months: Sequence[tuple[int, int]]) -> Column:
    """Runs of months as ranges: they reach the scan, however many months there are."""
    condition = F.lit(False)
    for first, last in months:
        condition = condition | F.col(MONTH).between(first, last)
    return condition


def _whole_months(model: StarModel, condition: Column | None, period: tuple[date, date] | None) -> list[tuple[int, int]] | None:
    """Runs of months that a date filter keeps; empty without a filter, None if it cuts a month.

    The calendar has a row per day; what comes to the driver is a row per month.
    """
    if condition is None and period is None:
        return []
    kept = F.lit(True)
    if condition is not None:
        kept = kept & F.coalesce(condition, F.lit(False))
    if period:
        kept = kept & F.col("full_date").between(F.lit(period[0]), F.lit(period[1]))
    rows = _months(model).groupBy(MONTH).agg(F.bool_and(kept).alias("all"), F.bool_or(kept).alias("some")).orderBy(MONTH).collect()
    if any(r["some"] != r["all"] for r in rows):
        return None
    runs: list[tuple[int, int]] = []
    previous = False
    for r in rows:
        if r["all"]:
            runs = [*runs[:-1], (runs[-1][0], r[MONTH])] if previous else [*runs, (r[MONTH], r[MONTH])]
        previous = r["all"]
    return runs or [(0, 0)]


def build_rollups(spark: SparkSession, layers: Layers) -> None:
    """Writes the roll-ups of the stored facts beside them."""
    for fact in LEVELS:
        rows = read_table(spark, layers.gold, fact)
        write_table(
            rolled_up(rows, fact), layers.gold, sums_table(fact), layers.fmt, overwrite_schema=True, partition_by=["level"]
        )
        if fact in BITMAP_KEYS:
            write_table(
                month_bitmaps(rows, fact), layers.gold, bitmap_table(fact), layers.fmt,
                overwrite_schema=True, partition_by=[MONTH], cluster_by=["brand_key"],
            )


def level_sizes(sums: Mapping[str, DataFrame]) -> DataFrame:
    """``(fact, level, rows)`` of stored sums: what the choice of a level goes by."""
    frames = [
        df.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(fact).alias("fact"), "level", "rows")
        for fact, df in sums.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def load_rollups(spark: SparkSession, layers: Layers) -> Rollups:
    sums = {f: read_table(spark, layers.gold, sums_table(f)) for f in LEVELS}
    sets = {f: read_table(spark, layers.gold, bitmap_table(f)) for f in BITMAP_KEYS}
    return Rollups(sums, sets, {(r.fact, r.level): r.rows for r in level_sizes(sums).collect()})
