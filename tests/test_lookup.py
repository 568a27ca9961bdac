import pytest
from pyspark.sql import functions as F

from galley.operators.lookup import (
    Lookup,
    drill_across,
    joined_rows,
    left_lookup,
    orphan_keys,
    orphan_rows,
    summary_per_parent,
)


@pytest.fixture
def fact(spark):
    return spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "b"), (4, "zz"), (5, None), (6, None), (7, "-3")],
        "id int, code string",
    )


@pytest.fixture
def dim(spark):
    # "-3" looks like a stand-in for null keys; it must match its own rows only.
    return spark.createDataFrame([("a", 10), ("b", 20), ("-3", 30), (None, 40)], "code string, key int")


@pytest.mark.parametrize("spread", [None, "id"])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_lookup_keeps_every_row_once(spark, rows, fact, dim, spread, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = left_lookup(fact, Lookup(dim, "code", "code", {"key": "key"}, spread))
        assert rows(found, "id", "key") == sorted(
            [(1, 10), (2, 10), (3, 20), (4, None), (5, None), (6, None), (7, 30)], key=repr
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_keys_are_spread_over_partitions(spark, dim):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        anonymous = spark.range(4000).select("id", F.lit(None).cast("string").alias("code"))
        look = Lookup(dim, "code", "code", {"key": "key"}, "id")
        used = left_lookup(anonymous, look).select(F.spark_partition_id().alias("p")).distinct()
        assert used.count() > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_orphans_leave_out_null_keys(spark, rows, fact, dim):
    assert rows(orphan_rows(fact, "code", dim, "code")) == [(4, "zz")]
    assert rows(orphan_keys(fact, "code", dim, "code")) == [("zz", 1)]


def test_joined_rows_counts_what_a_join_would_give(spark, fact):
    names = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "name string, k int")
    real = fact.join(names, fact.code == names.name, "left").count()
    assert tuple(joined_rows(fact, "code", names, "name").first()) == (fact.count(), real)


def test_drill_across_matches_null_groups(spark, rows):
    one = spark.createDataFrame([("a", 1), (None, 2)], "g string, x int")
    two = spark.createDataFrame([("b", 5), (None, 7)], "g string, y int")
    assert rows(drill_across([one, two], ["g"])) == sorted(
        [("a", 1, None), ("b", None, 5), (None, 2, 7)], key=repr
    )


def test_summary_keeps_parents_without_children(spark, rows):
    parents = spark.createDataFrame([(1, "p"), (2, "q")], "id int, name string")
    children = spark.createDataFrame([(1, 5.0), (1, 6.0)], "parent int, v double")
    out = summary_per_parent(
        parents,
        children,
        ("id", "parent"),
        ["id", "name"],
        {"n": F.count("v"), "total": F.sum("v")},
        zero=["n"],
    )
    assert rows(out) == [(1, "p", 2, 11.0), (2, "q", 0, None)]


def test_hot_key_of_a_lookup_is_split(spark, tmp_path):
    """A key with half of all rows, with thresholds low enough for a small table."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in low.items():
        spark.conf.set(name, value)
    try:
        spark.range(0, 200000, 1, 8).select(
            "id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1000).alias("code")
        ).write.parquet(str(tmp_path / "fact"))
        fact = spark.read.parquet(str(tmp_path / "fact"))
        dim = spark.range(1000).select("id", (F.col("id") * 10).alias("key"))
        found = left_lookup(fact, Lookup(dim, "code", "id", {"key": "key"}))
        assert found.where("key = code * 10").count() == 200000
        rows_seen = found.select(F.spark_partition_id().alias("p")).groupBy("p").count()
        out = found.groupBy().agg(F.count("key"), F.sum("key"))
        assert out.collect()[0][0] == 200000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert rows_seen.agg(F.max("count")).first()[0] < 100000
    finally:
        for name in low:
            spark.conf.unset(name)
