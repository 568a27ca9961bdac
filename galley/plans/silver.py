"""Raw tables -> cleaned, deduplicated, typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.columns import as_boolean, as_day, enforce, with_audit
from galley.operators.keys import dense_key, distinct_on_ids, first_per_key
from galley.operators.registry import KeyRegistry

CONTENT_COLUMNS = [
    "content_key",
    "content_id",
    "title",
    "brand",
    "section",
    "content_type",
    "publish_date",
    "author",
    "word_count",
]
SUBSCRIPTION_COLUMNS = [
    "subscriber_key",
    "subscriber_id",
    "brand",
    "signup_date",
    "plan",
    "region",
    "channel",
    "is_active",
    "churn_date",
    "mrr",
]
ENGAGEMENT_COLUMNS = [
    "event_id",
    "event_timestamp",
    "event_date",
    "brand",
    "content_id",
    "subscriber_id",
    "platform",
    "page_views",
    "sessions",
    "time_on_page_sec",
]
AD_COLUMNS = [
    "impression_id",
    "impression_timestamp",
    "impression_date",
    "brand",
    "campaign_id",
    "campaign_name",
    "advertiser",
    "channel",
    "platform",
    "impressions",
    "clicks",
    "ad_revenue",
]


def with_key(
    df: DataFrame, column: str, name: str, key_type: str, ids: DataFrame, keys: KeyRegistry | None
) -> DataFrame:
    """Keys of this run, or those of a registry, which stay the same from run to run."""
    if keys is None:
        return dense_key(df, column, name, key_type, ids=ids)
    return keys.keyed(df, column, name, key_type, ids)


def silver_content(raw: DataFrame, key_type: str = "int", keys: KeyRegistry | None = None) -> DataFrame:
    """One row per content id (earliest publish date), with a dense or a registered key."""
    kept = first_per_key(raw, ["content_id"], ["publish_date"])
    keyed = with_key(kept, "content_id", "content_key", key_type, raw, keys)
    return with_audit(keyed.select(*CONTENT_COLUMNS))


def silver_subscriptions(
    raw: DataFrame, key_type: str = "int", keys: KeyRegistry | None = None
) -> DataFrame:
    """One row per subscriber id (latest signup), with a key as above and a real boolean."""
    kept = first_per_key(raw, ["subscriber_id"], [F.col("signup_date").desc_nulls_last()])
    typed = kept.withColumn("is_active", as_boolean(F.col("is_active")))
    keyed = with_key(typed, "subscriber_id", "subscriber_key", key_type, raw, keys)
    return with_audit(keyed.select(*SUBSCRIPTION_COLUMNS))


def _event_table(
    raw: DataFrame, key: str, day: tuple[str, Column], positive: str, integers: list[str]
) -> DataFrame:
    # Deduplicate first: a duplicate is settled before its measures are judged, as the
    # filter must see the surviving row only.
    kept = distinct_on_ids(raw, key)
    typed = enforce(kept, {c: "int" for c in integers}).withColumn(*day)
    return typed.where(F.col(positive) > 0)


def silver_engagement(raw: DataFrame) -> DataFrame:
    """Unique events with at least one page view (null counts as none)."""
    rows = _event_table(
        raw,
        "event_id",
        ("event_date", as_day(F.col("event_timestamp"))),
        "page_views",
        ["page_views", "sessions", "time_on_page_sec"],
    )
    return with_audit(rows.select(*ENGAGEMENT_COLUMNS))


def silver_ad_impressions(raw: DataFrame) -> DataFrame:
    """Unique ad rows with at least one impression."""
    rows = _event_table(
        raw,
        "impression_id",
        ("impression_date", as_day(F.col("impression_timestamp"))),
        "impressions",
        ["impressions", "clicks"],
    )
    return with_audit(rows.select(*AD_COLUMNS))
