"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Options every job relies on. Partition sizes stay at Spark's defaults (AQE coalesces
# and splits at run time), so the same code runs on one machine and on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    name: str = "galley", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the defaults above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread_partitions(spark: SparkSession) -> int:
    """Partitions for rows that are few now but expand later.

    Given as a number, they are not merged at run time, where Spark would judge them by
    their size before the expansion.
    """
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffles, spark.sparkContext.defaultParallelism)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder in the session's warehouse takes its place: the
    warehouse is shared by the driver and all executors too.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
