"""Data-quality checks. Every check yields rows ``(check, target, violations, passed)``.

Rules that look at one row at a time (nulls, signs, row predicates) and table-wide simple
aggregates are collected per table and answered by a single scan, or by the write of the table
itself (``Observed``); only uniqueness and referential integrity need a shuffle of their own, and
both count per key before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.functions.columns import not_true, relative_difference
from galley.operators.lookup import orphan_keys
from galley.sources.catalog import exists

CHECK_SCHEMA = T.StructType(
    [
        T.StructField("check", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("violations", T.LongType(), False),
        T.StructField("passed", T.BooleanType(), False),
    ]
)


class QualityError(RuntimeError):
    """A gate found failing checks."""


# --- rules answered by one scan of a table ---------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``observable`` rules are sums over rows; those that look for distinct values are not."""

    check: str
    target: str
    violations: Column
    observable: bool = True


def rule_not_empty() -> Rule:
    return Rule("not_empty", "*", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0))


def rule_no_null(column: str) -> Rule:
    return Rule("no_nulls", column, F.count_if(F.col(column).isNull()))


def rule_non_negative(column: str) -> Rule:
    """Negative values; a nan is no amount and counts too."""
    value = F.col(column)
    return Rule("non_negative", column, F.count_if((value < 0) | F.isnan(value.cast("double"))))


def rule_expect(name: str, condition: Column) -> Rule:
    """Every row must satisfy the condition; rows where it is unknown (null) pass."""
    return Rule("expect", name, F.count_if(not_true(condition)))


def rule_no_gaps(column: str) -> Rule:
    """One row for each day between the first and the last: missing and repeated days count."""
    expected = F.datediff(F.max(column), F.min(column)) + 1
    days = F.count_distinct(column)
    return Rule("no_gaps", column, (expected - days) + (F.count(F.lit(1)) - days), observable=False)


def table_checks(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """All rules of one table in one aggregate, unpivoted to one row per rule."""
    counted = df.agg(
        *[F.coalesce(r.violations, F.lit(0)).cast("long").alias(f"v{i}") for i, r in enumerate(rules)]
    )
    rows = [
        F.struct(
            F.lit(r.check).alias("check"),
            F.lit(table if r.target == "*" else f"{table}.{r.target}").alias("target"),
            F.col(f"v{i}").alias("violations"),
            (F.col(f"v{i}") == 0).alias("passed"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


class Observed:
    """Rules and figures of a table, gathered by the write that makes it.

    ``watch`` is applied to what is written, after its last shuffle: those tasks count once, also
    when executors are lost and earlier stages run again. After the write, ``rows``, ``figures`` and
    ``checks`` tell what went by, without reading the table. Rules that cannot be observed are
    left to a scan of the written table.
    """

    def __init__(self, table: str, rules: Sequence[Rule] = (), figures: Mapping[str, Column] | None = None) -> None:
        self.table = table
        self.rules = [r for r in rules if r.observable]
        self.others = [r for r in rules if not r.observable]
        self._figures = dict(figures or {})
        self._observation = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        counted = [F.coalesce(r.violations, F.lit(0)).cast("long").alias(f"v{i}") for i, r in enumerate(self.rules)]
        figures = [c.alias(f"f{i}") for i, c in enumerate(self._figures.values())]
        return df.observe(self._observation, F.count(F.lit(1)).alias("rows"), *counted, *figures)

    @property
    def rows(self) -> int:
        return self._observation.get["rows"]

    @property
    def figures(self) -> dict[str, object]:
        seen = self._observation.get
        return {name: seen[f"f{i}"] for i, name in enumerate(self._figures)}

    def checks(self, spark: SparkSession, written: DataFrame | None = None) -> DataFrame:
        """Check rows; ``written`` is the table, for rules that need a scan."""
        seen = self._observation.get
        found = [
            (r.check, self.table if r.target == "*" else f"{self.table}.{r.target}", seen[f"v{i}"], seen[f"v{i}"] == 0)
            for i, r in enumerate(self.rules)
        ]
        rows = spark.createDataFrame(found, CHECK_SCHEMA)
        if self.others:
            if written is None:
                raise ValueError(f"{self.table} has rules that need a scan")
            rows = rows.unionByName(table_checks(written, self.table, self.others))
        return rows


def not_empty(df: DataFrame, table: str) -> DataFrame:
    return table_checks(df, table, [rule_not_empty()])


def no_nulls(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return table_checks(df, table, [rule_no_null(c) for c in columns])


def non_negative(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return table_checks(df, table, [rule_non_negative(c) for c in columns])


def expect(df: DataFrame, table: str, name: str, condition: Column) -> DataFrame:
    return table_checks(df, table, [rule_expect(name, condition)])


def no_gaps(df: DataFrame, table: str, column: str) -> DataFrame:
    return table_checks(df, table, [rule_no_gaps(column)])


# --- checks with a shuffle --------------------------------------------------------------


def _one_row(counted: DataFrame, check: str, target: str) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return counted.select(
        F.lit(check).alias("check"),
        F.lit(target).alias("target"),
        n.alias("violations"),
        (n == 0).alias("passed"),
    )


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key columns, rows) of every key that occurs more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Violations are the keys that occur more than once."""
    counted = duplicate_keys(df, columns).agg(F.count(F.lit(1)).alias("n"))
    return _one_row(counted, "unique", f"{table}.{'+'.join(columns)}")


def fk_exists(
    fact: DataFrame, table: str, fk: str, dim: DataFrame, dim_table: str, pk: str
) -> DataFrame:
    """Violations are fact rows whose non-null key is missing in the dimension.

    Null keys are a matter of ``no_nulls``; counting them here too would report one fault
    twice.
    """
    counted = orphan_keys(fact, fk, dim, pk).agg(F.sum("rows").alias("n"))
    return _one_row(counted, "fk_exists", f"{table}.{fk}->{dim_table}.{pk}")


def _per_target(
    spark: SparkSession, check: str, targets: Sequence[str], found: DataFrame
) -> DataFrame:
    """One row per target; those without a row in ``found`` (target, n) have no violation."""
    listed = spark.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    )
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return listed.join(found, "target", "left").select(
        F.lit(check).alias("check"), "target", n.alias("violations"), (n == 0).alias("passed")
    )


def unique_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """``unique`` for the integer keys of many tables, with one shuffle for all of them."""
    tagged = [
        tables[t].select(F.lit(f"{t}.{k}").alias("target"), F.col(k).cast("long").alias("key"))
        for t, k in keys.items()
    ]
    every_key = run_suite(tagged)
    found = (
        duplicate_keys(every_key, ["target", "key"])
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    targets = [f"{t}.{k}" for t, k in keys.items()]
    return _per_target(every_key.sparkSession, "unique", targets, found)


def link_rows(
    tables: Mapping[str, DataFrame], relationships: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """``(fact, dim, key, rows, keyed, matched)`` of every relationship of a star with integer keys.

    ``rows`` are all rows of the fact, ``keyed`` those with a key, ``matched`` those whose key the
    dimension has. Each fact is read once and counted per (relationship, key) with map-side
    combining; the counts are joined once to the keys of that fact's dimensions.
    """
    parts = []
    for fact, dims in relationships.items():
        pairs = [
            F.struct(F.lit(dim).alias("dim"), F.lit(key).alias("key"), F.col(key).cast("long").alias("value"))
            for dim, key in dims.items()
        ]
        counted = (
            tables[fact]
            .select(F.inline(F.array(*pairs)))
            .groupBy("dim", "key", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        known = run_suite(
            [
                tables[dim].select(F.lit(dim).alias("__dim"), F.col(key).cast("long").alias("__value"))
                for dim, key in dims.items()
            ]
        )
        same = (F.col("dim") == F.col("__dim")) & (F.col("value") == F.col("__value"))
        parts.append(counted.join(known, same, "left").withColumn("fact", F.lit(fact)))
    n = F.col("n")
    return (
        run_suite(parts)
        .groupBy("fact", "dim", "key")
        .agg(
            F.sum(n).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("keyed"),
            F.coalesce(F.sum(F.when(F.col("__value").isNotNull(), n)), F.lit(0)).alias("matched"),
        )
    )


def star_links_exist(
    tables: Mapping[str, DataFrame], relationships: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """``fk_exists`` for every relationship of a star, from one ``link_rows``."""
    target = F.format_string("%s.%s->%s.%s", "fact", "key", "dim", "key")
    found = link_rows(tables, relationships).select(
        target.alias("target"), (F.col("keyed") - F.col("matched")).alias("n")
    )
    targets = [f"{f}.{k}->{d}.{k}" for f, dims in relationships.items() for d, k in dims.items()]
    return _per_target(found.sparkSession, "fk_exists", targets, found)


def same_count(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """A lookup join must keep the number of rows."""
    first = before.agg(F.count(F.lit(1)).alias("n"))
    second = after.agg((-F.count(F.lit(1))).alias("n"))
    counted = first.unionByName(second).agg(F.abs(F.sum("n")).alias("n"))
    return _one_row(counted, "same_count", target)


def same_rows(before: Observed, after: Observed, target: str) -> DataFrame:
    """``same_count`` of two observed writes."""
    return _from_schema(SparkSession.active(), "same_count", target, abs(after.rows - before.rows))


# --- checks on the schema alone ---------------------------------------------------------


def _from_schema(spark: SparkSession, check: str, target: str, faults: int) -> DataFrame:
    return spark.createDataFrame([(check, target, faults, faults == 0)], CHECK_SCHEMA)


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def has_columns(df: DataFrame, table: str, names: Sequence[str]) -> DataFrame:
    return _from_schema(df.sparkSession, "has_columns", table, len(missing_columns(df, names)))


def contract(df: DataFrame, table: str, key_type: str = "int") -> DataFrame:
    """Gold contract: no column is complex, and ``*_key`` columns are 32-bit integers, or
    of the wider ``key_type`` chosen for very large tables."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    faults = sum(
        isinstance(f.dataType, nested)
        or (f.name.endswith("_key") and f.dataType.simpleString() not in ("int", key_type))
        for f in df.schema.fields
    )
    return _from_schema(df.sparkSession, "contract", table, faults)


def tables_exist(spark: SparkSession, layer: str, tables: Sequence[str]) -> DataFrame:
    """One row per table name; a violation is a table the catalog does not have."""
    found = [(t, exists(spark, layer, t)) for t in tables]
    return spark.createDataFrame(
        [("exists", f"{layer}.{t}", int(not there), there) for t, there in found], CHECK_SCHEMA
    )


# --- reconciliation ---------------------------------------------------------------------


def reconcile(measured: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Compare two ``(measure, value)`` tables.

    A missing or null value counts as 0. Both zero passes, an expected zero against
    anything else fails, otherwise the relative difference decides.
    """
    left = measured.select("measure", F.col("value").cast("double").alias("measured"))
    right = expected.select("measure", F.col("value").cast("double").alias("expected"))
    both = left.join(right, "measure", "full").fillna(0.0, ["measured", "expected"])
    diff = relative_difference(F.col("measured"), F.col("expected"))
    passed = F.when(F.col("expected") == 0, F.col("measured") == 0).otherwise(diff <= tolerance)
    return both.select("measure", "measured", "expected", passed.alias("passed"))


def reconciliation_checks(compared: DataFrame) -> DataFrame:
    return compared.select(
        F.lit("reconcile").alias("check"),
        F.col("measure").alias("target"),
        F.when(F.col("passed"), 0).otherwise(1).cast("long").alias("violations"),
        F.col("passed"),
    )


# --- suites -----------------------------------------------------------------------------


def run_suite(checks: Sequence[DataFrame]) -> DataFrame:
    """One table of all check rows; the counting stays on the executors."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def summarise(results: DataFrame) -> DataFrame:
    """One row: checks, failed, passed."""
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def gate(results: DataFrame, ignore: Mapping[str, str] | None = None) -> DataFrame:
    """Raise if a check fails; ``ignore`` maps accepted targets to the reason.

    The result rows (one per check) are kept, so the counting runs once.
    """
    rows = results.collect()
    accepted = set(ignore or {})
    bad = [r for r in rows if not r.passed and r.target not in accepted]
    if bad:
        lines = [f"{r.check} {r.target}: {r.violations}" for r in bad]
        raise QualityError("failed checks: " + "; ".join(lines))
    return results.sparkSession.createDataFrame(rows, CHECK_SCHEMA)
