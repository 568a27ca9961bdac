"""What a run has finished: steps with a fingerprint of their input.

A step that is in the journal with the fingerprint its input has now, and whose tables are there,
is not done again. A step is written down after it has ended, its checks included; one that stops
half way is done again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.sources import versions
from galley.sources.catalog import ensure_layer, exists, read_table

TABLE = "run_journal"
SCHEMA = "step string, fingerprint string, finished_at timestamp"


def _summed(rows: DataFrame, mark: Column) -> str:
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("s")).first()
    return f"{found.n}:{found.s}"


def row_fingerprint(df: DataFrame) -> str:
    """Changes with the rows, whatever they come from. All of them are read."""
    return "rows " + _summed(df, F.xxhash64(*sorted(df.columns)))


def table_fingerprint(spark: SparkSession, layer: str, name: str) -> str:
    """Of a stored table: its published version, or names, sizes and times of its files.

    No column is read for it.
    """
    if spark.catalog.getTable(f"{layer}.{name}").tableType == "VIEW":
        return f"version {versions.current(spark, layer, name)}"
    table = read_table(spark, layer, name)
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return "files " + _summed(files, F.xxhash64(*files.columns))


@dataclass(frozen=True)
class Journal:
    """The journal of a layer, a table that only grows."""

    spark: SparkSession
    layer: str
    location: str | None = None

    def entries(self) -> DataFrame:
        if not exists(self.spark, self.layer, TABLE):
            return self.spark.createDataFrame([], SCHEMA)
        return read_table(self.spark, self.layer, TABLE)

    def last(self, step: str) -> str | None:
        """Fingerprint of the step when it was last finished."""
        found = self.entries().where(F.col("step") == step).orderBy(F.desc("finished_at")).first()
        return found.fingerprint if found else None

    def step(
        self,
        name: str,
        build: Callable[[], object],
        made: Sequence[tuple[str, str]],
        inputs: Mapping[str, DataFrame] | None = None,
        tables: Sequence[tuple[str, str]] = (),
        settings: str = "",
    ) -> bool:
        """Does a step unless it is done; True if it was done now.

        ``made`` are its tables ``(layer, table)``. ``inputs`` may be any rows; ``tables`` are stored
        ones.
        """
        marks = [f"{t}={row_fingerprint(df)}" for t, df in sorted((inputs or {}).items())]
        marks += [f"{t}={table_fingerprint(self.spark, layer, t)}" for layer, t in tables]
        now = "; ".join([settings, *marks])
        if self.last(name) == now and all(exists(self.spark, *table) for table in made):
            return False
        build()
        ensure_layer(self.spark, self.layer, self.location)
        entry = self.spark.createDataFrame([(name, now)], "step string, fingerprint string")
        entry.withColumn("finished_at", F.current_timestamp()).write.mode("append").saveAsTable(f"{self.layer}.{TABLE}")
        return True
