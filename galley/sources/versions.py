"""Replacing a table safely: a new version beside the old one, then one switch in the catalog.

A published table is a view over its newest version, a table of its own. Readers see the old
version until the new one is written and has passed its check; a write that fails half way, or a
check that fails, changes nothing for them. The version before stays for a way back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.sources.catalog import _quoted, exists, read_table, write_table

_SHOWN = "published_version"


def _named(name: str, version: str) -> str:
    return f"{name}__{version}"


def versions(spark: SparkSession, layer: str, name: str) -> list[str]:
    """Stored versions, oldest first."""
    found = spark.sql(f"SHOW TABLES IN {_quoted(layer)} LIKE '{name}__v*'").select("tableName").collect()
    return sorted(r.tableName.removeprefix(f"{name}__") for r in found)


def current(spark: SparkSession, layer: str, name: str) -> str | None:
    """The version that readers see."""
    if not exists(spark, layer, name):
        return None
    shown = spark.sql(f"SHOW TBLPROPERTIES {_quoted(layer, name)}").where(F.col("key") == _SHOWN).first()
    if shown is None:
        raise ValueError(f"{layer}.{name} is a table that was not published")
    return shown["value"]


def _show(spark: SparkSession, layer: str, name: str, version: str) -> None:
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(layer, name)} TBLPROPERTIES ('{_SHOWN}' = '{version}') "
        f"AS SELECT * FROM {_quoted(layer, _named(name, version))}"
    )


def _drop(spark: SparkSession, layer: str, name: str, version: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(layer, _named(name, version))}")


def publish(
    df: DataFrame,
    layer: str,
    name: str,
    check: Callable[[DataFrame], object] | None = None,
    keep: int = 1,
    **layout,
) -> DataFrame:
    """Writes ``df`` as the new version of a table and switches readers to it.

    ``df`` may read the table it replaces. ``check`` gets the written rows and raises if they must
    not be shown; the new version is then dropped. ``keep`` older versions stay. ``layout`` is that of
    ``write_table``. The schema may change from version to version.
    """
    spark = df.sparkSession
    current(spark, layer, name)  # refuses a table that was not published
    last = max((int(v.split("_")[0][1:]) for v in versions(spark, layer, name)), default=0)
    # the random part keeps a place apart from what a broken write has left there
    version = f"v{last + 1:06d}_{uuid.uuid4().hex[:8]}"
    try:
        write_table(df, layer, _named(name, version), **layout)
        if check:
            check(read_table(spark, layer, _named(name, version)))
    except Exception:
        _drop(spark, layer, name, version)
        raise
    _show(spark, layer, name, version)
    earlier = [v for v in versions(spark, layer, name) if v != version]
    for old in earlier[: len(earlier) - keep]:
        _drop(spark, layer, name, old)
    return read_table(spark, layer, name)


def roll_back(spark: SparkSession, layer: str, name: str) -> DataFrame:
    """Shows the version before the one that is shown."""
    shown = current(spark, layer, name)
    earlier = [v for v in versions(spark, layer, name) if shown and v < shown]
    if not earlier:
        raise ValueError(f"{layer}.{name} has no earlier version")
    _show(spark, layer, name, earlier[-1])
    return read_table(spark, layer, name)
