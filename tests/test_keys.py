import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from galley.operators.keys import (
    dense_key,
    distinct_on,
    distinct_on_ids,
    first_per_key,
)

ROWS = [
    ("a", 3, "x"),
    ("a", 1, "z"),
    ("a", 1, "y"),
    ("b", 5, None),
    ("b", 5, "q"),
    (None, 2, "n"),
    (None, 1, "m"),
]


def table(spark):
    return spark.createDataFrame(ROWS, "k string, v int, t string")


def test_first_per_key_breaks_ties_by_the_other_columns(spark, rows):
    kept = first_per_key(table(spark), ["k"], ["v"])
    assert rows(kept) == sorted([("a", 1, "y"), ("b", 5, None), (None, 1, "m")], key=repr)


def test_latest_per_key(spark, rows):
    kept = first_per_key(table(spark), ["k"], [F.col("v").desc_nulls_last()])
    assert ("a", 3, "x") in rows(kept)


def test_distinct_on_keeps_the_smallest_row(spark, rows):
    assert ("a", 1, "y") in rows(distinct_on(table(spark), ["k"]))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_dedup_does_not_depend_on_partitioning(spark, rows, partitions):
    many = spark.range(5000).select((F.col("id") % 700).alias("k"), (F.col("id") % 13).alias("v"), "id")
    expected = rows(first_per_key(many.coalesce(1), ["k"], ["v"]))
    assert rows(first_per_key(many.repartition(partitions), ["k"], ["v"])) == expected


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_key(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_exchange


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_dense_key_equals_the_global_sort(spark, rows, partitions):
    names = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") * 37 % 3001).alias("name"))
    order = Window.orderBy("name")
    small = names.withColumn("key", F.row_number().over(order))
    large = dense_key(names.repartition(partitions), "name", "key", partitions=partitions)
    assert rows(large, "name", "key") == rows(small, "name", "key")
    assert dict(large.dtypes)["key"] == "int"


def test_dense_key_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").cast("string").alias("name"))
    assert dense_key(empty, "name", "key").count() == 0


def test_dense_key_broadcasts_offsets_only(spark):
    names = spark.range(3000).select(F.col("id").cast("string").alias("name"))
    keyed = dense_key(names, "name", "key")
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[__part" in plan


def test_dense_key_takes_ids_from_elsewhere_and_keeps_null(spark, rows):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "name string, v int")
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string")
    assert rows(dense_key(df, "name", "key", ids=ids), "name", "v", "key") == sorted(
        [(None, 2, 1), ("a", 3, 2), ("b", 1, 3)], key=repr
    )


def _with_repeats(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 100 == 0, F.lit(None))
        .when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("e"), F.col("id") - F.col("id") % 2))
        .alias("k"),
        (F.col("id") % 17).alias("v"),
        "id",
    )


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_distinct_ids_equal_the_plain_way(spark, rows, threshold):
    """A hot id, null ids, pairs and single ids, with and without a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        many = _with_repeats(spark)
        assert rows(distinct_on_ids(many, "k")) == rows(distinct_on(many, ["k"]))
        unique = many.select("id", "v")
        assert rows(distinct_on_ids(unique, "id")) == rows(unique)
        assert distinct_on_ids(many.limit(0), "k").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distinct_ids_run_no_job_while_they_are_built(spark):
    group = "building"
    spark.sparkContext.setJobGroup(group, group)
    try:
        distinct_on_ids(_with_repeats(spark), "k")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_distinct_ids_move_rows_once_whatever_the_repeats(spark, rows):
    """No shuffle join of the rows with their counts, however large Spark takes these to be."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = distinct_on_ids(_with_repeats(spark), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    few = plan[: plan.index("BroadcastHashJoin")]
    assert few.count("Exchange") == 1  # and nothing is sorted before it
    assert "Sort" not in few[few.index("Exchange") :]


def test_crowded_ids_are_reduced_before_the_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr("galley.operators.keys.HOT_ROWS", 100)
    many = _with_repeats(spark)
    found = distinct_on_ids(many, "k")
    assert rows(found) == rows(distinct_on(many, ["k"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    crowded = plan[plan.index("LeftAnti") :]
    assert "WindowGroupLimit" in crowded[crowded.index("ENSURE_REQUIREMENTS") :]
