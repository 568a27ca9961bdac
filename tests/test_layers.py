"""Silver and gold builders on hand-made rows, edge cases included."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galley import schemas
from galley.operators import quality as q
from galley.plans import gold, silver
from galley.sources import seeds

D = Decimal


@pytest.fixture(scope="module")
def raw_content(spark):
    return spark.createDataFrame(
        [
            ("CNT000002", "late copy", "Bravo", "Home", "Video", date(2026, 4, 2), "Author1", 400),
            ("CNT000002", "early", "Bravo", "Home", "Video", date(2026, 4, 1), "Author1", 400),
            ("CNT000001", "b tie", "Alpha", "Food", "Recipe", date(2026, 4, 5), None, None),
            ("CNT000001", "a tie", "Alpha", "Food", "Recipe", date(2026, 4, 5), None, None),
            ("CNT000003", "no such brand", "Nowhere", "Food", "Recipe", date(2026, 4, 5), None, 5),
        ],
        schemas.RAW_CONTENT,
    )


@pytest.fixture(scope="module")
def raw_subscriptions(spark):
    s = [
        ("SUB0000001", "Alpha", date(2026, 4, 1), "basic", "West", "email", True, None, 9.99),
        ("SUB0000001", "Bravo", date(2026, 5, 1), "family", "West", "email", True, None, 19.99),
        ("SUB0000002", "Alpha", date(2026, 6, 1), "basic", "West", "direct", False, date(2026, 6, 3), 9.99),
        # signed up on the last day of the data
        ("SUB0000003", "Bravo", date(2026, 6, 5), "premium", "West", "email", True, None, 14.99),
        # churn on the last day of the data
        ("SUB0000004", "Bravo", date(2026, 6, 4), "premium", "West", "email", False, date(2026, 6, 5), 14.99),
        # churn on the day of signup
        ("SUB0000005", "Bravo", date(2026, 6, 2), "premium", "West", "email", False, date(2026, 6, 2), 14.99),
    ]
    return spark.createDataFrame(s, schemas.RAW_SUBSCRIPTIONS)


@pytest.fixture(scope="module")
def raw_engagement(spark):
    t = datetime(2026, 5, 2, 23, 59, 59)
    return spark.createDataFrame(
        [
            ("EVT1", t, "Alpha", "CNT000001", "SUB0000001", "web", 3, 1, 90),
            ("EVT1", datetime(2026, 5, 3), "Alpha", "CNT000002", None, "ios", 9, 1, 90),
            ("EVT2", t, "Bravo", "CNT000002", None, "ios", 2, 1, 60),
            ("EVT3", t, "Nowhere", "CNT999999", "SUB9999999", "tv", 1, 1, 30),
            ("EVT4", t, "Alpha", "CNT000001", "SUB0000002", "web", 0, 1, 10),
            ("EVT5", t, "Alpha", "CNT000001", "SUB0000002", "web", -1, 1, 10),
        ],
        schemas.RAW_ENGAGEMENT,
    )


@pytest.fixture(scope="module")
def raw_ads(spark):
    t = datetime(2026, 5, 2, 12, 0, 0)
    return spark.createDataFrame(
        [
            # one campaign id under two names
            ("IMP1", t, "Alpha", "CMP001", "X Video Campaign", "X", "video", "web", 100, 2, 1.50),
            ("IMP2", t, "Alpha", "CMP001", "X Native Campaign", "X", "native", "web", 100, 1, 0.25),
            # two campaign ids under one name
            ("IMP3", t, "Bravo", "CMP002", "X Native Campaign", "X", "native", "ios", 200, 3, 2.25),
            ("IMP3", t, "Bravo", "CMP002", "X Native Campaign", "X", "native", "ios", 200, 3, 2.25),
            ("IMP4", t, "Bravo", "CMP002", "X Native Campaign", "X", "native", "ios", 0, 0, 0.0),
        ],
        schemas.RAW_AD_IMPRESSIONS,
    )


@pytest.fixture(scope="module")
def layers(spark, raw_content, raw_subscriptions, raw_engagement, raw_ads):
    t = {
        "content": silver.silver_content(raw_content),
        "subscriptions": silver.silver_subscriptions(raw_subscriptions),
        "engagement": silver.silver_engagement(raw_engagement),
        "ads": silver.silver_ad_impressions(raw_ads),
        "dates": gold.dim_date(spark),
        "brands": seeds.dim_brand(spark, ["Alpha", "Bravo"]),
        "platforms": seeds.dim_platform(spark),
    }
    t["dim_content"] = gold.dim_content(t["content"], t["brands"])
    t["dim_subscriber"] = gold.dim_subscriber(t["subscriptions"], t["dates"])
    t["dim_campaign"] = gold.dim_campaign(t["ads"])
    return t


def test_silver_content(layers, rows):
    assert rows(layers["content"], "content_key", "content_id", "title") == [
        (1, "CNT000001", "a tie"),
        (2, "CNT000002", "early"),
        (3, "CNT000003", "no such brand"),
    ]


def test_silver_subscriptions_keep_the_latest_signup(layers, rows):
    assert rows(layers["subscriptions"], "subscriber_key", "subscriber_id", "plan")[0] == (
        1,
        "SUB0000001",
        "family",
    )
    assert layers["subscriptions"].count() == 5


def test_boolean_text_is_accepted(spark, raw_subscriptions):
    text = raw_subscriptions.withColumn("is_active", F.col("is_active").cast("string"))
    out = silver.silver_subscriptions(text)
    assert dict(out.dtypes)["is_active"] == "boolean"
    assert out.where("is_active").count() == 2


def test_silver_engagement(layers, rows):
    assert rows(layers["engagement"], "event_id", "event_date", "page_views") == [
        ("EVT1", date(2026, 5, 2), 3),
        ("EVT2", date(2026, 5, 2), 2),
        ("EVT3", date(2026, 5, 2), 1),
    ]


def test_null_measures_are_dropped(spark, raw_engagement):
    nulls = raw_engagement.withColumn("page_views", F.lit(None).cast("int"))
    assert silver.silver_engagement(nulls).count() == 0


def test_silver_ads(layers, rows):
    assert rows(layers["ads"], "impression_id", "impressions") == [("IMP1", 100), ("IMP2", 100), ("IMP3", 200)]


def test_audit_column_is_last(layers):
    for name in ("content", "subscriptions", "engagement", "ads"):
        assert layers[name].columns[-1] == "load_timestamp"


def test_calendar(spark):
    days = gold.dim_date(spark)
    assert days.count() == 456
    first = days.orderBy("date_key").first()
    assert (first.date_key, first.full_date, first.date, first.weekday) == (
        1,
        date(2026, 3, 25),
        date(2026, 3, 25),
        "Wednesday",
    )
    last = days.orderBy(F.desc("date_key")).first()
    assert last.date_key == gold.date_key_of(date(2027, 6, 23), date(2026, 3, 25)) == 456


def test_gold_keys_are_32_bit(layers):
    for name in ("dates", "brands", "platforms", "dim_content", "dim_subscriber", "dim_campaign"):
        assert q.contract(layers[name], name).first().passed


def test_unknown_brand_has_no_key(layers, rows):
    assert rows(layers["dim_content"], "content_id", "brand_key") == [
        ("CNT000001", 1),
        ("CNT000002", 2),
        ("CNT000003", None),
    ]


def test_subscriber_dimension(layers, rows):
    found = rows(layers["dim_subscriber"], "subscriber_id", "signup_date_key", "subscriber_tier")
    assert found[0] == ("SUB0000001", 38, "family")


def test_campaign_attributes_are_the_smallest_combination(layers, rows):
    assert rows(layers["dim_campaign"], "campaign_key", "campaign_id", "campaign_name") == [
        (1, "CMP001", "X Native Campaign"),
        (2, "CMP002", "X Native Campaign"),
    ]


def test_engagement_fact_keeps_rows_and_nulls(layers, rows):
    fact = gold.fct_engagement(
        layers["engagement"], layers["dates"], layers["brands"],
        layers["dim_content"], layers["dim_subscriber"], layers["platforms"],
    )
    assert rows(fact) == sorted(
        [
            (39, 1, 1, 1, 1, 3, 1, 90),
            (39, 2, 2, None, 2, 2, 1, 60),
            (39, None, None, None, None, 1, 1, 30),
        ],
        key=repr,
    )


def test_ad_fact_does_not_fan_out(layers, rows):
    fact = gold.fct_ad(
        layers["ads"], layers["dates"], layers["brands"], layers["dim_campaign"], layers["platforms"]
    )
    assert rows(fact, "campaign_key", "impressions", "ad_revenue") == [
        (1, 100, D("0.25")),
        (1, 100, D("1.50")),
        (2, 200, D("2.25")),
    ]


def test_subscription_fact(layers, rows):
    fact = gold.fct_subscription(layers["subscriptions"], layers["dates"], layers["brands"])
    assert rows(fact, "subscriber_key", "active_flag", "new_flag", "churned_flag", "mrr") == [
        (1, 1, 1, 0, D("19.99")),
        (2, 0, 1, 1, D("9.99")),
        (3, 1, 1, 0, D("14.99")),
        (4, 0, 1, 1, D("14.99")),
        (5, 0, 1, 1, D("14.99")),
    ]


def test_snapshot_bounds(layers, rows):
    start, end = date(2026, 3, 25), date(2026, 6, 5)
    snapshot = gold.subscription_snapshot(layers["subscriptions"], layers["brands"], start, end)

    def days(key):
        return rows(
            snapshot.where(F.col("subscriber_key") == key),
            "date_key", "active_flag", "new_flag", "churned_flag",
        )

    last = gold.date_key_of(end, start)
    assert days(2) == [(last - 4, 1, 1, 0), (last - 3, 1, 0, 0), (last - 2, 0, 0, 1)]
    assert days(3) == [(last, 1, 1, 0)]
    assert days(4) == [(last - 1, 1, 1, 0), (last, 0, 0, 1)]
    assert days(5) == [(last - 3, 0, 1, 1)]
    assert len(days(1)) == 36


def test_daily_totals_equal_the_snapshot(layers, rows):
    start, end = date(2026, 3, 25), date(2026, 6, 5)
    snapshot = gold.subscription_snapshot(layers["subscriptions"], layers["brands"], start, end)
    slow = snapshot.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("subscribers"),
        F.sum("active_flag").alias("active"),
        F.sum("new_flag").alias("new"),
        F.sum("churned_flag").alias("churned"),
        F.sum("mrr").alias("mrr"),
    )
    fast = gold.subscription_daily_totals(layers["subscriptions"], layers["dates"], end)
    assert rows(fast) == rows(slow)


def test_snapshot_and_totals_agree_outside_the_range(spark, rows):
    """Signups before the calendar, churn after the end of the data, before the signup, before the calendar."""
    day = date.fromisoformat
    subscriptions = spark.createDataFrame(
        [
            (1, "Alpha", day("2026-01-01"), None, 10.0),
            (2, "Alpha", day("2026-01-05"), day("2026-04-02"), 20.0),
            (3, "Alpha", day("2026-04-02"), day("2026-04-20"), 5.0),
            (4, "Alpha", day("2026-04-03"), day("2026-04-01"), 7.0),
            (5, "Alpha", day("2026-01-01"), day("2026-02-01"), 9.0),
            (6, "Alpha", day("2026-05-01"), None, 9.0),
        ],
        "subscriber_key int, brand string, signup_date date, churn_date date, mrr double",
    )
    brands = spark.createDataFrame([(1, "Alpha")], "brand_key int, brand_name string")
    start, end = day("2026-04-01"), day("2026-04-04")
    dates = gold.dim_date(spark, start, day("2026-04-10"))
    snapshot = gold.subscription_snapshot(subscriptions, brands, start, end)
    assert rows(snapshot, "date_key", "subscriber_key", "active_flag", "new_flag", "churned_flag") == sorted(
        [(d, 1, 1, 0, 0) for d in (1, 2, 3, 4)]
        + [(1, 2, 1, 0, 0), (2, 2, 0, 0, 1)]
        + [(2, 3, 1, 1, 0), (3, 3, 1, 0, 0), (4, 3, 1, 0, 0)],
        key=repr,
    )
    slow = snapshot.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("subscribers"),
        F.sum("active_flag").alias("active"),
        F.sum("new_flag").alias("new"),
        F.sum("churned_flag").alias("churned"),
        F.sum("mrr").alias("mrr"),
    )
    assert rows(gold.subscription_daily_totals(subscriptions, dates, end)) == rows(slow)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_silver_does_not_depend_on_partitioning(raw_ads, raw_content, rows, partitions):
    for build, raw in ((silver.silver_ad_impressions, raw_ads), (silver.silver_content, raw_content)):
        expected = rows(build(raw.coalesce(1)).drop("load_timestamp"))
        assert rows(build(raw.repartition(partitions)).drop("load_timestamp")) == expected
