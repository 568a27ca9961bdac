"""Silver tables -> six dimensions and three facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions.columns import MONEY, calendar_columns, flag
from galley.operators.keys import dense_key, first_per_key
from galley.operators.lookup import Lookup, left_lookup, star_lookup
from galley.operators.registry import KeyRegistry
from galley.plans.silver import with_key

# Fixed range of the default calendar.
CALENDAR_START = date(2026, 3, 25)
CALENDAR_END = date(2027, 6, 23)


# --- dimensions -------------------------------------------------------------------------


def dim_date(
    spark: SparkSession, start: date = CALENDAR_START, end: date = CALENDAR_END
) -> DataFrame:
    """One row per day, both ends included; ``date_key`` counts the days from 1."""
    days = spark.range(0, 1, 1, 1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("d")
    )
    key = (F.datediff("d", F.lit(start)) + 1).alias("date_key")
    return days.select(key, *[c.alias(n) for n, c in calendar_columns(F.col("d")).items()])


def date_key_of(day: date, calendar_start: date) -> int:
    """Key of a day, without reading the dimension."""
    return (day - calendar_start).days + 1


def with_month(fact: DataFrame, calendar_start: date) -> DataFrame:
    """Adds ``date_month`` (YYYYMM), computed from the date key, to partition a fact by."""
    day = F.date_add(F.lit(calendar_start), F.col("date_key") - 1)
    return fact.withColumn("date_month", F.year(day) * 100 + F.month(day))


def dim_brand_from(values: DataFrame, column: str, key_type: str = "int") -> DataFrame:
    """Brand dimension from the distinct brands of a table, keyed in the order of names."""
    names = values.select(F.col(column).alias("brand_name")).distinct()
    return dense_key(names, "brand_name", "brand_key", key_type).select("brand_key", "brand_name")


def dim_content(content: DataFrame, brands: DataFrame) -> DataFrame:
    looked_up = left_lookup(content, Lookup(brands, "brand", "brand_name", {"brand_key": "brand_key"}))
    return looked_up.select(
        "content_key", "content_id", "title", "section", "content_type", "author", "brand_key"
    )


def dim_subscriber(subscriptions: DataFrame, dates: DataFrame) -> DataFrame:
    looked_up = left_lookup(
        subscriptions, Lookup(dates, "signup_date", "full_date", {"date_key": "signup_date_key"})
    )
    return looked_up.select(
        "subscriber_key",
        "subscriber_id",
        "signup_date_key",
        "plan",
        "region",
        "channel",
        F.col("plan").alias("subscriber_tier"),
        F.col("channel").alias("acquisition_channel"),
    )


def dim_campaign(
    ads: DataFrame, key_type: str = "int", keys: KeyRegistry | None = None
) -> DataFrame:
    """One row per campaign id; where its attributes vary, the smallest combination.

    A campaign has many ads: its combinations are made distinct by hash before any are sorted.
    """
    columns = ["campaign_id", "campaign_name", "advertiser", "channel"]
    kept = first_per_key(ads.select(*columns).distinct(), ["campaign_id"])
    keyed = with_key(kept, "campaign_id", "campaign_key", key_type, ads, keys)
    return keyed.select("campaign_key", *columns, F.col("channel").alias("campaign_type"))


# --- facts ------------------------------------------------------------------------------


def _dates(dates: DataFrame, column: str) -> Lookup:
    return Lookup(dates, column, "full_date", {"date_key": "date_key"})


def _brands(brands: DataFrame) -> Lookup:
    return Lookup(brands, "brand", "brand_name", {"brand_key": "brand_key"})


def _platforms(platforms: DataFrame) -> Lookup:
    return Lookup(platforms, "platform", "platform", {"platform_key": "platform_key"})


def fct_engagement(
    engagement: DataFrame,
    dates: DataFrame,
    brands: DataFrame,
    content: DataFrame,
    subscribers: DataFrame,
    platforms: DataFrame,
) -> DataFrame:
    """Grain: one event. ``subscriber_key`` is null for anonymous traffic.

    The small dimensions come first, so wide text columns are gone before the lookups
    that may shuffle. Anonymous events are spread, as they all share the null key.
    """
    rows = engagement.drop("event_timestamp", "load_timestamp")
    small = star_lookup(
        rows, [_dates(dates, "event_date"), _brands(brands), _platforms(platforms)]
    ).drop("event_date", "brand", "platform")
    keyed = star_lookup(
        small,
        [
            Lookup(content, "content_id", "content_id", {"content_key": "content_key"}),
            Lookup(
                subscribers,
                "subscriber_id",
                "subscriber_id",
                {"subscriber_key": "subscriber_key"},
                spread_nulls_by="event_id",
            ),
        ],
    )
    return keyed.select(
        "date_key",
        "brand_key",
        "content_key",
        "subscriber_key",
        "platform_key",
        *[F.col(c).cast("int") for c in ("page_views", "sessions", "time_on_page_sec")],
    )


def fct_subscription(subscriptions: DataFrame, dates: DataFrame, brands: DataFrame) -> DataFrame:
    """Grain: one subscriber, dated at signup; ``new_flag`` is 1 throughout."""
    keyed = star_lookup(subscriptions, [_dates(dates, "signup_date"), _brands(brands)])
    return keyed.select(
        "date_key",
        "brand_key",
        "subscriber_key",
        flag(F.col("is_active")).alias("active_flag"),
        F.lit(1).alias("new_flag"),
        flag(~F.col("is_active")).alias("churned_flag"),
        F.col("mrr").cast(MONEY).alias("mrr"),
    )


def fct_ad(
    ads: DataFrame,
    dates: DataFrame,
    brands: DataFrame,
    campaigns: DataFrame,
    platforms: DataFrame,
) -> DataFrame:
    """Grain: one ad row. Campaigns are found by id: their names are not unique."""
    rows = ads.select(
        "impression_date", "brand", "campaign_id", "platform", "impressions", "clicks", "ad_revenue"
    )
    keyed = star_lookup(
        rows,
        [
            _dates(dates, "impression_date"),
            _brands(brands),
            _platforms(platforms),
            Lookup(campaigns, "campaign_id", "campaign_id", {"campaign_key": "campaign_key"}),
        ],
    )
    return keyed.select(
        "date_key",
        "brand_key",
        "campaign_key",
        "platform_key",
        F.col("impressions").cast("int"),
        F.col("clicks").cast("int"),
        F.col("ad_revenue").cast(MONEY).alias("ad_revenue"),
    )


# --- daily snapshot ---------------------------------------------------------------------


# Days that one row of the snapshot's input expands to after the last shuffle.
RUN_DAYS = 31


def _stay(subscriptions: DataFrame, data_end: date) -> DataFrame:
    """Subscriptions with the last day they are on record, ``data_end`` at the latest.

    A churn after the end of the data has not been seen yet and is dropped. A churn before the
    signup is no stay; ``silver_checks`` counts such rows.
    """
    end = F.lit(data_end)
    seen = F.when(F.col("churn_date") <= end, F.col("churn_date"))
    known = F.coalesce(F.col("churn_date") >= F.col("signup_date"), F.lit(True))
    return (
        subscriptions.where(known & (F.col("signup_date") <= end))
        .withColumn("churn_date", seen)
        .withColumn("end_date", F.coalesce(F.col("churn_date"), end))
    )


def subscription_stays(
    subscriptions: DataFrame, brands: DataFrame, calendar_start: date, data_end: date
) -> DataFrame:
    """The daily snapshot as intervals: one row per subscriber, from the first day to the last.

    ``from_key`` to ``to_key`` are the days that the snapshot has rows for; ``churn_key`` is the last
    of them where the subscriber churned. It grows with subscribers, the snapshot with their days.
    """
    first_day = F.lit(calendar_start)
    day = lambda c: F.datediff(c, first_day) + 1
    stays = left_lookup(_stay(subscriptions, data_end), _brands(brands)).select(
        "brand_key",
        "subscriber_key",
        F.greatest(day("signup_date"), F.lit(1)).alias("from_key"),
        day("end_date").alias("to_key"),
        day("churn_date").alias("churn_key"),
        F.col("mrr").cast(MONEY).alias("mrr"),
    )
    return stays.where(F.col("to_key") >= 1)


def subscription_snapshot(
    subscriptions: DataFrame, brands: DataFrame, calendar_start: date, data_end: date
) -> DataFrame:
    """Grain: subscriber and day, from signup to the churn day or the end of the data.

    Days before the calendar are left out; a subscriber of that time starts on its first day,
    not as new.

    Active on every day before the churn day, new on the first day, churned on the churn
    day. The lookups run per subscriber; days are added last, as a run of date keys
    (arithmetic on the calendar start) on a narrow row, so the expanded rows never
    shuffle. Stays are cut into runs of ``RUN_DAYS`` days first and the runs are rebalanced:
    Spark sizes the tasks by what there is, and each row grows by a run at most afterwards.
    """
    first_day = F.lit(calendar_start)
    narrow = left_lookup(_stay(subscriptions, data_end), _brands(brands)).select(
        "brand_key",
        "subscriber_key",
        (F.datediff("signup_date", first_day) + 1).alias("signup_key"),
        (F.datediff("end_date", first_day) + 1).alias("end_key"),
        (F.datediff("churn_date", first_day) + 1).alias("churn_key"),
        F.col("mrr").cast(MONEY).alias("mrr"),
    )
    inside = narrow.where(F.col("end_key") >= 1)
    first = F.greatest("signup_key", F.lit(1))
    runs = inside.withColumn("from_key", F.explode(F.sequence(first, F.col("end_key"), F.lit(RUN_DAYS))))
    last = F.least(F.col("from_key") + (RUN_DAYS - 1), F.col("end_key"))
    daily = runs.hint("rebalance").withColumn("date_key", F.explode(F.sequence("from_key", last)))
    churns = F.coalesce(F.col("date_key") == F.col("churn_key"), F.lit(False))
    return daily.select(
        "date_key",
        "brand_key",
        "subscriber_key",
        flag(~churns).alias("active_flag"),
        flag(F.col("date_key") == F.col("signup_key")).alias("new_flag"),
        flag(churns).alias("churned_flag"),
        "mrr",
    )


def subscription_daily_totals(
    subscriptions: DataFrame, dates: DataFrame, data_end: date
) -> DataFrame:
    """(date_key, subscribers, active, new, churned, mrr) per day, without the snapshot rows.

    Each subscriber contributes a change on the day it appears and another on the day
    after it is last seen; the totals are the running sum of the changes over the
    calendar. Changes before the calendar make its opening balance. Work grows with
    subscribers, not with subscribers times days. The running sum is over one row per
    calendar day.
    """
    first_day = dates.agg(F.min("full_date")).scalar()
    mrr = F.col("mrr").cast(MONEY)
    left = flag(F.col("churn_date").isNotNull())
    on_record = [
        F.struct(
            F.col("signup_date").alias("day"),
            F.lit(1).alias("rows"),
            F.lit(1).alias("active"),
            F.lit(1).alias("new"),
            F.lit(0).alias("churned"),
            mrr.alias("mrr"),
        ),
        F.struct(
            F.col("end_date").alias("day"),
            F.lit(0).alias("rows"),
            (-left).alias("active"),
            F.lit(0).alias("new"),
            left.alias("churned"),
            F.lit(0).cast(MONEY).alias("mrr"),
        ),
        F.struct(
            F.date_add("end_date", 1).alias("day"),
            F.lit(-1).alias("rows"),
            (left - 1).alias("active"),
            F.lit(0).alias("new"),
            F.lit(0).alias("churned"),
            (-mrr).cast(MONEY).alias("mrr"),
        ),
    ]
    changes = (
        _stay(subscriptions, data_end)
        .select(F.inline(F.array(*on_record)))
        .select(
            F.greatest(F.col("day"), first_day).alias("day"),
            "rows",
            "active",
            *[F.when(F.col("day") >= first_day, F.col(c)).otherwise(0).alias(c) for c in ("new", "churned")],
            "mrr",
        )
        .groupBy("day")
        .agg(*[F.sum(c).alias(c) for c in ("rows", "active", "new", "churned", "mrr")])
    )
    so_far = Window.orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    per_day = (
        dates.where(F.col("full_date") <= F.lit(data_end))
        .select("date_key", "full_date")
        .join(changes, F.col("full_date") == F.col("day"), "left")
        .fillna(0, ["rows", "active", "new", "churned"])
    )
    money = F.coalesce(F.col("mrr"), F.lit(0).cast(MONEY))
    totals = per_day.select(
        "date_key",
        F.sum("rows").over(so_far).alias("subscribers"),
        F.sum("active").over(so_far).alias("active"),
        "new",
        "churned",
        F.sum(money).over(so_far).alias("mrr"),
    )
    return totals.where(F.col("subscribers") > 0)
