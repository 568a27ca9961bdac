"""Table schemas. Columns and types are fixed; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "decimal(18,2)": T.DecimalType(18, 2),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}


def _schema(*fields: str) -> T.StructType:
    """'name type' is nullable, 'name type!' is not."""
    out = T.StructType()
    for text in fields:
        name, kind = text.split(" ", 1)
        out.add(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"))
    return out


RAW_CONTENT = _schema(
    "content_id string!",
    "title string!",
    "brand string!",
    "section string!",
    "content_type string!",
    "publish_date date!",
    "author string",
    "word_count int",
)

RAW_SUBSCRIPTIONS = _schema(
    "subscriber_id string!",
    "brand string!",
    "signup_date date!",
    "plan string!",
    "region string!",
    "channel string!",
    "is_active boolean!",
    "churn_date date",
    "mrr double!",
)

RAW_ENGAGEMENT = _schema(
    "event_id string",
    "event_timestamp timestamp!",
    "brand string!",
    "content_id string!",
    "subscriber_id string",
    "platform string!",
    "page_views int!",
    "sessions int!",
    "time_on_page_sec int!",
)

RAW_AD_IMPRESSIONS = _schema(
    "impression_id string",
    "impression_timestamp timestamp!",
    "brand string!",
    "campaign_id string!",
    "campaign_name string!",
    "advertiser string!",
    "channel string!",
    "platform string!",
    "impressions int!",
    "clicks int!",
    "ad_revenue double!",
)

SAMPLE_EVENTS = _schema(
    "event_id int!",
    "event_type string!",
    "user_id string!",
    "timestamp timestamp!",
    "properties string",
)

EXAMPLE_AUDIENCE = _schema(
    "brand string", "channel string", "sessions bigint", "subscribers bigint"
)

SALES_CUSTOMER = _schema(
    "customer_id int!",
    "customer_name string!",
    "email string",
    "region string",
    "created_date date",
)

SALES_ORDER = _schema(
    "order_id int!",
    "customer_id int!",
    "order_date date!",
    "order_total decimal(18,2)",
    "order_status string",
)

APP_CONFIG = _schema(
    "config_key string!",
    "config_value string",
    "description string",
    "last_updated timestamp",
)

DIM_BRAND = _schema("brand_key int!", "brand_name string!")

DIM_PLATFORM = _schema("platform_key int!", "platform string!")
