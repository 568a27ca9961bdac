from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from galley.functions import columns as c


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_enforce_is_strict_or_lenient(spark):
    df = spark.createDataFrame([("12",), ("x",)], "a string")
    assert [r.a for r in c.enforce(df, {"a": "int"}, lenient=True).collect()] == [12, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        c.enforce(df, {"a": "int"}).collect()


def test_boolean_from_text_and_boolean(spark):
    assert one(spark, c.as_boolean(F.col("t")), t="false") is False
    assert one(spark, c.as_boolean(F.col("t")), t=True) is True


def test_flag_is_zero_for_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "a int")
    assert [r[0] for r in df.select(c.flag(F.col("a") == 1)).collect()] == [1, 0, 0]


@pytest.mark.parametrize("top,bottom,expected", [(1, 4, 25.0), (1, 0, 0.0), (None, 4, 0.0)])
def test_safe_ratio(spark, top, bottom, expected):
    df = spark.createDataFrame([(top, bottom)], "a int, b int")
    assert df.select(c.safe_ratio(F.col("a"), F.col("b"), 100)).first()[0] == expected


def test_padded_id_never_cuts(spark):
    ids = [one(spark, c.prefixed_id("EVT", F.lit(n), 4)) for n in (7, 1234, 123456)]
    assert ids == ["EVT0007", "EVT1234", "EVT123456"]


def test_price_table(spark):
    prices = {"basic": 9.99, "premium": 14.99}
    found = [one(spark, c.price_of(F.lit(p), prices, 19.99)) for p in ("basic", "premium", "family")]
    assert found == [9.99, 14.99, 19.99]


def test_calendar_of_a_saturday(spark):
    parts = c.calendar_columns(F.lit(date(2026, 3, 28)))
    row = spark.range(1).select(*[v.alias(k) for k, v in parts.items()]).first().asDict()
    assert row["year"] == 2026 and row["quarter"] == 1 and row["month_name"] == "March"
    assert row["weekday"] == "Saturday" and row["day_of_week"] == 6 and row["is_weekend"]
    assert row["date_int"] == 20260328


def test_day_of_a_timestamp(spark):
    assert one(spark, c.as_day(F.col("t")), t=datetime(2026, 3, 25, 23, 59, 59)) == date(2026, 3, 25)


@pytest.mark.parametrize(
    "fmt,value,text",
    [
        ("#,##0", 1234567.0, "1,234,567"),
        ("#,##0.00", 1234.5, "1,234.50"),
        ("$#,##0", -1234.0, "($1,234)"),
        ("$#,##0.00", 12.345678, "$12.35"),
        ("0.00%", 9.8, "9.80%"),
    ],
)
def test_display(spark, fmt, value, text):
    assert one(spark, c.DISPLAY[fmt](F.lit(value))) == text


def test_draws_do_not_depend_on_partitioning(spark, rows):
    salts = {"a": 11, "b": 12}
    one_part = c.with_draws(spark.range(0, 2000, 1, 1), "id", salts)
    many = c.with_draws(spark.range(0, 2000, 1, 16).repartition(7), "id", salts)
    assert rows(one_part) == rows(many)


def test_draws_are_spread_and_independent(spark):
    df = c.with_draws(spark.range(20000), "id", {"a": 11, "b": 12}).select(
        c.drawn_int(F.col("draw_a"), 0, 4).alias("a"), c.drawn_int(F.col("draw_b"), 0, 4).alias("b")
    )
    counts = [r["count"] for r in df.groupBy("a", "b").count().collect()]
    assert len(counts) == 25 and min(counts) > 600 and max(counts) < 1000
