"""Layers (catalog databases), table sinks and sources, views and catalog probes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layers:
    """Where a stage keeps its tables. The same job runs per stage with other names.

    ``location`` is the folder of the databases; without it they go to the warehouse
    folder of the session. ``versioned`` layers publish their tables (``versions.publish``): a
    table is replaced in one step, and the one before stays for a way back.
    """

    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    fmt: str = "parquet"
    location: str | None = None
    versioned: bool = False

    @classmethod
    def for_stage(
        cls, stage: str, fmt: str = "parquet", location: str | None = None, versioned: bool = False
    ) -> Layers:
        return cls(f"{stage}_bronze", f"{stage}_silver", f"{stage}_gold", fmt, location, versioned)

    def names(self) -> tuple[str, str, str]:
        return self.bronze, self.silver, self.gold


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def ensure_layer(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f"{location}/{name}".replace("\\", "\\\\").replace("'", "\\'")
    where = f" LOCATION '{place}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}{where}")


def ensure_layers(spark: SparkSession, layers: Layers) -> None:
    for name in layers.names():
        ensure_layer(spark, name, layers.location)


def read_table(spark: SparkSession, layer: str, name: str) -> DataFrame:
    return spark.table(_quoted(layer, name))


def write_table(
    df: DataFrame,
    layer: str,
    name: str,
    fmt: str | None = "parquet",
    overwrite_schema: bool = False,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replace (or append to) a managed table.

    ``fmt=None`` takes the session's default format. Parquet tables always take the new
    schema on overwrite; the option is for formats that ask for it. A job must not
    overwrite a table it reads.

    ``partition_by`` gives one folder per value, which filters on those columns skip. The
    rows are rebalanced on them first: few files per folder, and Spark splits a folder that
    would be too large for one task. ``cluster_by`` sorts inside each task, so that
    row-group statistics skip data for filters on those columns.

    ``watch`` sees the rows in the tasks that write them (``quality.Observed.watch``).

    Parquet files are compressed with zstd: layers are copies of one another, so what a run writes
    is several times its input.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    if watch:
        rows = watch(rows)
    if cluster_by:
        rows = rows.sortWithinPartitions(*partition_by, *cluster_by)
    writer = rows.write.mode(mode)
    if fmt:
        writer = writer.format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    if overwrite_schema:
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(_quoted(layer, name))


def replace_partitions(
    df: DataFrame,
    layer: str,
    name: str,
    partition_by: Sequence[str],
    cluster_by: Sequence[str] = (),
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Replaces the partitions that ``df`` has rows for, and no others.

    The folders of all other partitions keep their files. A partition that is to become empty has
    no rows to name it and stays. ``df`` must not read the table.

    The mode is a setting of the session, which is put back afterwards: overwrites that other
    threads of the session start meanwhile would be partial too.
    """
    spark = df.sparkSession
    setting = "spark.sql.sources.partitionOverwriteMode"
    table = _quoted(layer, name)
    rows = df.select(*spark.table(table).columns).hint("rebalance", *[F.col(c) for c in partition_by])
    if watch:
        rows = watch(rows)
    if cluster_by:
        rows = rows.sortWithinPartitions(*partition_by, *cluster_by)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)


def seed(
    spark: SparkSession, layer: str, name: str, rows: Sequence[tuple], schema: T.StructType
) -> None:
    """Append a few literal rows to a table."""
    frame = spark.createDataFrame(list(rows), schema)
    frame.write.mode("append").insertInto(_quoted(layer, name))


def ensure_table(
    spark: SparkSession, layer: str, name: str, schema: T.StructType, fmt: str = "parquet"
) -> None:
    """Create an empty table unless it exists. Keys are checked, not enforced, by Spark."""
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(layer, name)} ({columns}) USING {fmt}")


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Session view, replaced if present."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def create_layer_view(spark: SparkSession, layer: str, name: str, query: str) -> DataFrame:
    """Stored view in a layer, dropped and created again."""
    spark.sql(f"DROP VIEW IF EXISTS {_quoted(layer, name)}")
    spark.sql(f"CREATE VIEW {_quoted(layer, name)} AS {query}")
    return read_table(spark, layer, name)


def exists(
    spark: SparkSession, layer: str, table: str | None = None, column: str | None = None
) -> bool:
    """Whether a layer, a table in it, or a column of that table exists."""
    if not spark.catalog.databaseExists(layer):
        return False
    if table is None:
        return True
    if not spark.catalog.tableExists(_quoted(layer, table)):
        return False
    return column is None or column in spark.table(_quoted(layer, table)).columns


def describe(spark: SparkSession, layer: str, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {_quoted(layer, table)}")


def describe_columns(spark: SparkSession, layer: str, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {_quoted(layer, table)}").select("col_name", "data_type")


def preview(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows; with an order the same ones every time."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def first_value(df: DataFrame):
    """First column of the first row, or None."""
    row = df.limit(1).first()
    return None if row is None else row[0]


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables in one job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def layer_counts(spark: SparkSession, layer: str, tables: Sequence[str]) -> DataFrame:
    return row_counts({t: read_table(spark, layer, t) for t in tables})


def config_value(config: DataFrame, key: str) -> DataFrame:
    """One row with the value of a key, none if the key is unknown."""
    return config.where(F.col("config_key") == key).select("config_value")
