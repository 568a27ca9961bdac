"""Surrogate keys that stay: ids and their numbers in a stored table.

``dense_key`` numbers the ids of one run; a new id in the middle shifts all after it. A registry
remembers: ids it knows keep their number, new ones are numbered after the largest, in their order.
Facts written by different runs then agree on their keys. Ids that are not seen again keep theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.operators.keys import number_ids
from galley.sources.catalog import ensure_layer, ensure_table, read_table


@dataclass(frozen=True)
class KeyRegistry:
    """The registries of a layer, one table ``keys_<name>`` ``(id, key, batch)`` each.

    A run appends its new ids as one batch, in one commit: a run that fails before it leaves no
    trace, one that fails later finds its ids known when it is repeated. One run at a time may
    register ids of a name.
    """

    spark: SparkSession
    layer: str
    location: str | None = None

    def table(self, name: str) -> str:
        return f"keys_{name}"

    def known(self, name: str) -> DataFrame:
        return read_table(self.spark, self.layer, self.table(name))

    def register(self, ids: DataFrame, column: str, name: str) -> DataFrame:
        """``(id, key, batch)`` of all ids ever seen, those of ``column`` included.

        New ids are found by an anti-join of the distinct ids with the registry, which moves ids and
        no rows; a null id is an id like others. They are numbered as ``number_ids`` does, which
        writes them down first: the table is not read while it is appended to.
        """
        kind = ids.schema[column].dataType
        ensure_layer(self.spark, self.layer, self.location)
        schema = T.StructType(
            [T.StructField("id", kind), T.StructField("key", T.LongType()), T.StructField("batch", T.IntegerType())]
        )
        ensure_table(self.spark, self.layer, self.table(name), schema)
        known = self.known(name)
        seen = ids.select(F.col(column).alias("__new")).distinct()
        new = seen.join(known.select("id"), F.col("__new").eqNullSafe(F.col("id")), "left_anti")
        numbered = number_ids(new, "__new", "__number", "bigint")
        last = known.agg(F.coalesce(F.max("key"), F.lit(0)).alias("key"), F.coalesce(F.max("batch"), F.lit(0)).alias("batch")).first()
        rows = numbered.select(
            F.col("__new").alias("id"),
            (F.col("__number") + F.lit(last.key)).alias("key"),
            F.lit(last.batch + 1).alias("batch"),
        )
        rows.write.mode("append").insertInto(f"{self.layer}.{self.table(name)}")
        return self.known(name)

    def keyed(self, df: DataFrame, column: str, name: str, key_type: str = "int", ids: DataFrame | None = None) -> DataFrame:
        """``df`` with its registered keys. ``ids`` may name a cheaper source of the same values."""
        registered = self.register(df if ids is None else ids, column, name)
        keys = registered.select(F.col("id").alias("__id"), F.col("key").cast(key_type).alias(name))
        return df.join(keys, F.col(column).eqNullSafe(F.col("__id"))).drop("__id")
