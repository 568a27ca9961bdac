"""Seeded raw tables, generated on the executors.

Each generator maps rows that carry a dense ``id`` to raw rows; every value is a draw on
that id (see ``galley.functions.columns.draw``), so the output is the same under any
partitioning. ``row_ids`` and ``daily_rows`` provide such ids from ``spark.range`` or from
a table of days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions.columns import (
    at_time,
    drawn_between,
    drawn_choice,
    drawn_fraction,
    drawn_int,
    prefixed_id,
    price_of,
    with_draws,
)
from galley.session import spread_partitions

# Fixed values of the generated tables.
SECTIONS = (
    "Fashion",
    "Beauty",
    "Home",
    "Food",
    "Travel",
    "Health",
    "Entertainment",
    "Auto",
    "Technology",
)
CONTENT_TYPES = ("Article", "Video", "Gallery", "Recipe", "Review")
PLATFORMS = ("web", "ios", "android")
PLANS = ("basic", "premium", "family")
PLAN_PRICES = {"basic": 9.99, "premium": 14.99}
DEFAULT_PRICE = 19.99
REGIONS = ("Northeast", "Southeast", "Midwest", "Southwest", "West")
CHANNELS = ("organic", "paid_social", "email", "referral", "direct")
ADVERTISERS = (
    "BrandX Auto",
    "LuxuryY Fashion",
    "TechZ Gadgets",
    "BeautyA Cosmetics",
    "HomeB Furnishings",
)
AD_CHANNELS = ("display", "video", "native", "sponsored")
CAMPAIGNS = 50
AUTHORS = 50
ITEMS_PER_BRAND = 400
SUBSCRIBERS = 50_000
DAYS = 90
DATA_START = date(2026, 3, 25)
DATA_END = date(2026, 6, 23)
EVENTS_PER_DAY = (5000, 7000)
ADS_PER_DAY = (1000, 1500)
CHURN_SHARE = 0.10
SUBSCRIBER_TRAFFIC = 0.60
SEED = 42

# One salt per drawn column keeps the columns independent of each other.
_SALTS = {
    name: 101 * (i + 1)
    for i, name in enumerate(
        "section type publish author words signup plan region channel brand churn churn_day "
        "daily ev_brand content platform known subscriber views seconds hour minute second "
        "ad_brand campaign advertiser ad_channel ad_platform impressions ctr price".split()
    )
}

_ROWS_PER_CHUNK = 100_000


def salt(name: str, seed: int = SEED) -> int:
    return _SALTS[name] + seed


def _draws(rows: DataFrame, seed: int, names: str) -> DataFrame:
    return with_draws(rows, "id", {n: salt(n, seed) for n in names.split()})


def _d(name: str) -> Column:
    return F.col(f"draw_{name}")


def row_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def data_days(
    spark: SparkSession, start: date, days: int, per_day: tuple[int, int], seed: int = SEED
) -> DataFrame:
    """(day, rows): a drawn number of rows for each day."""
    return _draws(spark.range(days), seed, "daily").select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"),
        drawn_int(_d("daily"), *per_day).alias("rows"),
    )


def daily_rows(days: DataFrame, rows_per_chunk: int = _ROWS_PER_CHUNK) -> DataFrame:
    """(id, day): as many rows per day as ``rows`` says, with ids 0..n-1 in day order.

    A day is cut into chunks which are spread over the cluster before they are expanded,
    so a few days, or one very large day, do not bound the parallelism. The running total
    is over the calendar, which is short.
    """
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.where(F.col("rows") > 0).withColumn(
        "first", F.coalesce(F.sum(F.col("rows").cast("long")).over(earlier), F.lit(0))
    )
    last = F.col("first") + F.col("rows") - 1
    chunks = placed.select(
        "day",
        last.alias("last"),
        F.explode(F.sequence("first", last, F.lit(rows_per_chunk).cast("long"))).alias("start"),
    )
    spread = chunks.repartition(spread_partitions(days.sparkSession), "start")
    stop = F.least(F.col("start") + (rows_per_chunk - 1), F.col("last"))
    return spread.select(F.explode(F.sequence("start", stop)).alias("id"), "day")


def gen_content(
    ids: DataFrame,
    brands: Sequence[str],
    per_brand: int = ITEMS_PER_BRAND,
    start: date = DATA_START,
    days: int = DAYS,
    seed: int = SEED,
) -> DataFrame:
    """Content catalogue; item ids run through the brands in turn, ``per_brand`` each."""
    i = F.col("id")
    brand = F.element_at(
        F.array(*[F.lit(b) for b in brands]),
        (F.pmod(F.floor(i / per_brand), F.lit(len(brands))) + 1).cast("int"),
    )
    drawn = _draws(ids, seed, "section type publish author words").select(
        prefixed_id("CNT", i + 1, 6).alias("content_id"),
        (F.pmod(i, F.lit(per_brand)) + 1).alias("item"),
        brand.alias("brand"),
        drawn_choice(_d("section"), SECTIONS).alias("section"),
        drawn_choice(_d("type"), CONTENT_TYPES).alias("content_type"),
        F.date_add(F.lit(start), drawn_int(_d("publish"), 0, days - 30)).alias("publish_date"),
        F.concat(F.lit("Author"), drawn_int(_d("author"), 1, AUTHORS)).alias("author"),
        drawn_int(_d("words"), 300, 2500).alias("word_count"),
    )
    title = F.format_string("%s %s %s #%d", "brand", "section", "content_type", "item")
    return drawn.select(
        "content_id",
        title.alias("title"),
        "brand",
        "section",
        "content_type",
        "publish_date",
        "author",
        "word_count",
    )


def gen_subscriptions(
    ids: DataFrame,
    brands: Sequence[str],
    start: date = DATA_START,
    end: date = DATA_END,
    days: int = DAYS,
    seed: int = SEED,
) -> DataFrame:
    """Subscribers; one in ten draws a churn date, and stays active if it is after the end."""
    drawn = _draws(ids, seed, "brand signup plan region channel churn churn_day").select(
        prefixed_id("SUB", F.col("id") + 1, 7).alias("subscriber_id"),
        drawn_choice(_d("brand"), brands).alias("brand"),
        F.date_add(F.lit(start), drawn_int(_d("signup"), 0, days - 1)).alias("signup_date"),
        drawn_choice(_d("plan"), PLANS).alias("plan"),
        drawn_choice(_d("region"), REGIONS).alias("region"),
        drawn_choice(_d("channel"), CHANNELS).alias("channel"),
        (drawn_fraction(_d("churn")) <= CHURN_SHARE).alias("leaves"),
        drawn_int(_d("churn_day"), 7, days).alias("stay"),
    )
    leave_date = F.date_add("signup_date", F.col("stay"))
    churn_date = F.when(F.col("leaves") & (leave_date <= F.lit(end)), leave_date)
    return drawn.select(
        "subscriber_id",
        "brand",
        "signup_date",
        "plan",
        "region",
        "channel",
        churn_date.isNull().alias("is_active"),
        churn_date.alias("churn_date"),
        price_of(F.col("plan"), PLAN_PRICES, DEFAULT_PRICE).alias("mrr"),
    )


def _moment() -> Column:
    return at_time(
        F.col("day"),
        drawn_int(_d("hour"), 0, 23),
        drawn_int(_d("minute"), 0, 59),
        drawn_int(_d("second"), 0, 59),
    )


def gen_engagement(
    rows: DataFrame,
    brands: Sequence[str],
    contents: int | Column = 5 * ITEMS_PER_BRAND,
    subscribers: int | Column = SUBSCRIBERS,
    seed: int = SEED,
) -> DataFrame:
    """Page events for rows of (id, day); about 60 % have a subscriber."""
    names = "hour minute second ev_brand content platform known subscriber views seconds"
    known = drawn_fraction(_d("known")) < SUBSCRIBER_TRAFFIC
    views = drawn_int(_d("views"), 1, 12)
    return _draws(rows, seed, names).select(
        prefixed_id("EVT", F.col("id"), 12).alias("event_id"),
        _moment().alias("event_timestamp"),
        drawn_choice(_d("ev_brand"), brands).alias("brand"),
        prefixed_id("CNT", drawn_int(_d("content"), 1, contents), 6).alias("content_id"),
        F.when(known, prefixed_id("SUB", drawn_int(_d("subscriber"), 1, subscribers), 7)).alias(
            "subscriber_id"
        ),
        drawn_choice(_d("platform"), PLATFORMS).alias("platform"),
        views.alias("page_views"),
        F.lit(1).alias("sessions"),
        (views * drawn_int(_d("seconds"), 30, 300)).alias("time_on_page_sec"),
    )


def gen_ads(rows: DataFrame, brands: Sequence[str], seed: int = SEED) -> DataFrame:
    """Ad rows for rows of (id, day): 0.5-3 % clicks, 0.25-2.50 revenue per click."""
    names = (
        "hour minute second ad_brand campaign advertiser ad_channel ad_platform impressions ctr price"
    )
    drawn = _draws(rows, seed, names).select(
        prefixed_id("IMP", F.col("id"), 12).alias("impression_id"),
        _moment().alias("impression_timestamp"),
        drawn_choice(_d("ad_brand"), brands).alias("brand"),
        prefixed_id("CMP", drawn_int(_d("campaign"), 1, CAMPAIGNS), 3).alias("campaign_id"),
        drawn_choice(_d("advertiser"), ADVERTISERS).alias("advertiser"),
        drawn_choice(_d("ad_channel"), AD_CHANNELS).alias("channel"),
        drawn_choice(_d("ad_platform"), PLATFORMS).alias("platform"),
        drawn_int(_d("impressions"), 100, 5000).alias("impressions"),
        drawn_between(_d("ctr"), 0.005, 0.03).alias("ctr"),
        drawn_between(_d("price"), 0.25, 2.50).alias("price"),
    ).withColumn("clicks", F.floor(F.col("impressions") * F.col("ctr")).cast("int"))
    name = F.concat_ws(" ", "advertiser", F.initcap("channel"), F.lit("Campaign"))
    return drawn.select(
        "impression_id",
        "impression_timestamp",
        "brand",
        "campaign_id",
        name.alias("campaign_name"),
        "advertiser",
        "channel",
        "platform",
        "impressions",
        "clicks",
        F.round(F.col("clicks") * F.col("price"), 2).alias("ad_revenue"),
    )


def raw_tables(
    spark: SparkSession,
    brands: Sequence[str],
    days: int = DAYS,
    subscribers: int = SUBSCRIBERS,
    events_per_day: tuple[int, int] = EVENTS_PER_DAY,
    ads_per_day: tuple[int, int] = ADS_PER_DAY,
    start: date = DATA_START,
    end: date = DATA_END,
    seed: int = SEED,
) -> dict[str, DataFrame]:
    """The four raw tables at the sizes given."""
    contents = ITEMS_PER_BRAND * len(brands)
    events = daily_rows(data_days(spark, start, days, events_per_day, seed))
    ads = daily_rows(data_days(spark, start, days, ads_per_day, seed + 1))
    return {
        "raw_content": gen_content(
            row_ids(spark, contents), brands, start=start, days=days, seed=seed
        ),
        "raw_subscriptions": gen_subscriptions(
            row_ids(spark, subscribers), brands, start, end, days, seed
        ),
        "raw_engagement": gen_engagement(events, brands, contents, subscribers, seed),
        "raw_ad_impressions": gen_ads(ads, brands, seed),
    }
