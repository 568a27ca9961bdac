"""Small literal tables: static dimensions, sample rows, warehouse and config seeds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from galley import schemas

# Fixed values of the sample tables.

SAMPLE_EVENT_ROWS = [
    (1, "page_view", "user_123", datetime(2026, 6, 23, 10, 15, 0), '{"page": "/home"}'),
    (2, "click", "user_456", datetime(2026, 6, 23, 10, 20, 0), '{"element": "subscribe_button"}'),
    (3, "page_view", "user_789", datetime(2026, 6, 23, 10, 25, 0), '{"page": "/articles/tech"}'),
    (4, "scroll", "user_123", datetime(2026, 6, 23, 10, 30, 0), '{"depth": 75}'),
    (5, "exit", "user_456", datetime(2026, 6, 23, 10, 35, 0), '{"session_duration_sec": 300}'),
]

# (channel, sessions, subscribers); the brand of each row is the caller's.
EXAMPLE_AUDIENCE_FIGURES = [
    ("web", 1820, 240),
    ("mobile", 1310, 180),
    ("web", 1605, 205),
    ("app", 1490, 150),
]

SALES_CUSTOMER_ROWS = [
    (1, "Acme Corp", "contact@acme.com", "North America", date(2025, 1, 15)),
    (2, "Global Media Inc", "sales@globalmedia.com", "Europe", date(2025, 3, 20)),
    (3, "TechStart LLC", "info@techstart.com", "Asia Pacific", date(2025, 5, 10)),
]

SALES_ORDER_ROWS = [
    (101, 1, date(2026, 6, 1), Decimal("15000.00"), "completed"),
    (102, 1, date(2026, 6, 15), Decimal("8500.00"), "completed"),
    (103, 2, date(2026, 6, 10), Decimal("22000.00"), "pending"),
    (104, 3, date(2026, 6, 20), Decimal("5000.00"), "completed"),
]

CONFIG_BY_STAGE = {
    "DEV": ("dev-api", "DEBUG"),
    "UAT": ("uat-api", "INFO"),
    "PROD": ("api", "WARNING"),
}

PLATFORMS = ("web", "ios", "android")


def dim_brand(spark: SparkSession, brands: Sequence[str]) -> DataFrame:
    """Static dimension, keyed 1..n in the given order."""
    return spark.createDataFrame(list(enumerate(brands, 1)), schemas.DIM_BRAND)


def dim_platform(spark: SparkSession, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(platforms, 1)), schemas.DIM_PLATFORM)
    return rows.withColumn("platform_name", rows.platform)


def sample_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_EVENT_ROWS, schemas.SAMPLE_EVENTS)


def example_audience(spark: SparkSession, brands: Sequence[str]) -> DataFrame:
    rows = [(b, *f) for b, f in zip(brands, EXAMPLE_AUDIENCE_FIGURES, strict=True)]
    return spark.createDataFrame(rows, schemas.EXAMPLE_AUDIENCE)


def config_rows(stage: str, domain: str, now: datetime) -> list[tuple]:
    """Configuration of a stage (DEV, UAT or PROD)."""
    host, level = CONFIG_BY_STAGE[stage]
    return [
        ("environment", stage, "Current environment (DEV/UAT/PROD)", now),
        ("api_endpoint", f"https://{host}.{domain}", "API base URL", now),
        ("max_retry_count", "3", "Maximum retry attempts for failed operations", now),
        ("log_level", level, "Application logging level", now),
        (
            "feature_flags",
            '{"new_ui": true, "beta_analytics": false}',
            "JSON feature toggles",
            now,
        ),
    ]
