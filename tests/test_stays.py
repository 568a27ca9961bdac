"""Stays equal the expanded snapshot; intervals meet days in buckets."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from galley.operators.intervals import on_days
from galley.plans import gold, reports

START, END = date(2026, 1, 10), date(2026, 9, 20)


@pytest.fixture(scope="module")
def tables(spark):
    """Signups before, inside and after the calendar and the data, churns on and after the edges."""
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    signup = F.date_add(F.lit(date(2025, 11, 1)), h(1, 340))
    rows = spark.range(600).select(
        F.col("id").cast("int").alias("subscriber_key"), F.concat(F.lit("B"), h(2, 4)).alias("brand"), signup.alias("signup_date"),
        F.when(h(3, 3) > 0, F.date_add(signup, h(4, 200) - 3)).alias("churn_date"), F.lit(9.99).alias("mrr"),
    )
    brands = spark.createDataFrame([(1, "B0"), (2, "B1"), (3, "B2")], "brand_key int, brand_name string")
    return rows, brands


def plain(df):
    return sorted((tuple(None if v is None else float(v) for v in r) for r in df.collect()), key=repr)


def test_stays_equal_the_snapshot(spark, tables):
    stays = gold.subscription_stays(*tables, START, END).cache()
    daily = gold.with_month(gold.subscription_snapshot(*tables, START, END), START).cache()
    days = stays.select("subscriber_key", F.explode(F.sequence("from_key", "to_key")).alias("date_key"))
    assert plain(days) == plain(daily.select("subscriber_key", "date_key"))
    for day in (START, date(2026, 1, 31), date(2026, 5, 5), END):
        assert plain(reports.stays_on(stays, day, START)) == plain(reports.active_on(daily, day, START))
    dates = gold.dim_date(spark, START, date(2026, 12, 31))
    assert plain(reports.stays_by_month(stays, dates, END)) == plain(reports.mrr_by_month(daily))


@pytest.mark.parametrize("bucket", [1, 7, 31, 1000])
def test_intervals_meet_the_days_inside_them(spark, bucket):
    spans = [(1, 1, 1), (2, 30, 31), (3, 31, 62), (4, 1, 400), (5, 10, 9), (6, None, 5), (7, 5, None), (8, -40, -2), (9, 31, 31)]
    days = [-2, 0, 1, 9, 30, 31, 32, 62, 63, 400, 401, 31]
    intervals = spark.createDataFrame(spans, "id int, a int, b int")
    asked = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day int, n int")
    got = sorted((r.id, r.day, r.n) for r in on_days(intervals, asked, "day", "a", "b", bucket).collect())
    want = [(k, d, i) for k, a, b in spans for i, d in enumerate(days) if a is not None and b is not None and a <= d <= b]
    assert got == sorted(want)


def test_stays_are_not_compared_with_every_day(spark, tables):
    dates = gold.dim_date(spark, START, date(2026, 12, 31))
    plan = reports.stays_by_month(gold.subscription_stays(*tables, START, END), dates, END)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
