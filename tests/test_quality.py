from datetime import date

import pytest
from pyspark.sql import functions as F

from galley.operators import quality as q


def result(df):
    return {(r.check, r.target): (r.violations, r.passed) for r in df.collect()}


def test_not_empty(spark):
    assert result(q.not_empty(spark.range(3), "t")) == {("not_empty", "t"): (0, True)}
    assert result(q.not_empty(spark.range(0), "t")) == {("not_empty", "t"): (1, False)}


def test_planted_faults_are_found_once_each(spark):
    df = spark.createDataFrame(
        [(1, 5, 9), (2, -1, 9), (None, 3, 2), (2, 8, None)], "id int, clicks int, impressions int"
    )
    found = result(
        q.run_suite(
            [
                q.no_nulls(df, "t", ["id", "clicks"]),
                q.non_negative(df, "t", ["clicks"]),
                q.expect(df, "t", "rule", F.col("clicks") <= F.col("impressions")),
                q.unique(df, "t", ["id"]),
            ]
        )
    )
    assert found == {
        ("no_nulls", "t.id"): (1, False),
        ("no_nulls", "t.clicks"): (0, True),
        ("non_negative", "t.clicks"): (1, False),
        ("expect", "t.rule"): (1, False),
        ("unique", "t.id"): (1, False),
    }


def test_row_rules_of_a_table_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    df = spark.read.parquet(path)
    checks = q.table_checks(df, "t", [q.rule_not_empty(), q.rule_no_null("id"), q.rule_non_negative("id")])
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_missing_day_is_a_gap(spark):
    days = [date(2026, 1, d) for d in (1, 2, 4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert result(q.no_gaps(df, "t", "d")) == {("no_gaps", "t.d"): (1, False)}
    whole = df.union(spark.createDataFrame([(date(2026, 1, 3),)], "d date"))
    assert result(q.no_gaps(whole, "t", "d")) == {("no_gaps", "t.d"): (0, True)}


def test_a_repeated_day_does_not_hide_a_missing_one(spark):
    days = spark.createDataFrame([(1,), (1,), (3,)], "n int").select(F.make_date(F.lit(2024), F.lit(1), "n").alias("d"))
    assert result(q.no_gaps(days, "t", "d")) == {("no_gaps", "t.d"): (2, False)}


def test_a_nan_is_no_amount(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-1.0,), (None,)], "x double")
    assert result(q.non_negative(df, "t", ["x"])) == {("non_negative", "t.x"): (2, False)}


def test_foreign_keys_count_rows_and_skip_nulls(spark):
    fact = spark.createDataFrame([(1,), (7,), (7,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    assert result(q.fk_exists(fact, "f", "k", dim, "d", "k")) == {("fk_exists", "f.k->d.k"): (2, False)}


def test_star_checks_equal_the_single_ones(spark):
    tables = {
        "f": spark.createDataFrame([(1, 5), (7, 5), (7, None), (None, 6)], "a int, b int"),
        "da": spark.createDataFrame([(1,), (2,), (2,)], "a int"),
        "db": spark.createDataFrame([(5,), (6,)], "b int"),
    }
    links = q.star_links_exist(tables, {"f": {"da": "a", "db": "b"}})
    singles = q.fk_exists(tables["f"], "f", "a", tables["da"], "da", "a").unionByName(
        q.fk_exists(tables["f"], "f", "b", tables["db"], "db", "b")
    )
    assert result(links) == result(singles)
    assert result(links)[("fk_exists", "f.a->da.a")] == (2, False)
    keys = q.unique_keys(tables, {"da": "a", "db": "b"})
    assert result(keys) == {("unique", "da.a"): (1, False), ("unique", "db.b"): (0, True)}


def test_same_count(spark):
    assert result(q.same_count(spark.range(5), spark.range(8), "x"))[("same_count", "x")] == (3, False)
    assert result(q.same_count(spark.range(5), spark.range(5), "x"))[("same_count", "x")] == (0, True)


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, [1])], "brand_key bigint, tags array<int>")
    assert result(q.contract(df, "t")) == {("contract", "t"): (2, False)}
    assert result(q.has_columns(df, "t", ["brand_key", "name"])) == {("has_columns", "t"): (1, False)}


@pytest.mark.parametrize(
    "measured,expected,passed",
    [(0.0, 0.0, True), (1.0, 0.0, False), (100.9, 100.0, True), (101.1, 100.0, False), (None, 5.0, False)],
)
def test_reconcile(spark, measured, expected, passed):
    left = spark.createDataFrame([("m", measured)], "measure string, value double")
    right = spark.createDataFrame([("m", expected)], "measure string, value double")
    assert q.reconcile(left, right).first().passed is passed


def test_reconcile_reports_a_measure_missing_on_one_side(spark):
    left = spark.createDataFrame([("m", 1.0)], "measure string, value double")
    right = spark.createDataFrame([("n", 1.0)], "measure string, value double")
    assert {r.measure: r.passed for r in q.reconcile(left, right).collect()} == {"m": False, "n": False}


def test_gate_and_summary(spark):
    good, bad = q.not_empty(spark.range(1), "good"), q.not_empty(spark.range(0), "bad")
    assert tuple(q.summarise(good.unionByName(bad)).first()) == (2, 1, False)
    assert q.gate(good).count() == 1
    with pytest.raises(q.QualityError, match="not_empty bad: 1"):
        q.gate(good.unionByName(bad))
    assert q.gate(good.unionByName(bad), ignore={"bad": "known"}).count() == 2
