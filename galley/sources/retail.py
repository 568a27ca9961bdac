"""Retail tables in the roles of the media tables.

``part`` plays content, ``customer`` with ``orders`` plays subscriptions, ``events`` plays
engagement and ``lineitem`` plays ad impressions. The mapping uses columns of the tables
and integer arithmetic on their keys only, so every figure grows with the tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.columns import MONEY, prefixed_id, price_of
from galley.plans.gold import dim_brand_from
from galley.plans.pipeline import Calendar
from galley.sources.files import read_parquet
from galley.sources.seeds import dim_platform

CALENDAR = Calendar(date(1995, 1, 1), date(2024, 12, 31))
# Customers without an order from this day on count as churned.
CHURN_CUTOFF = date(2001, 1, 1)
# Last day of the order data; the daily snapshot ends here.
DATA_END = date(2001, 12, 31)

PLATFORMS = ("click", "error", "purchase", "signup", "view")
ANONYMOUS = ("error", "view")
PRICES = {
    "AUTOMOBILE": 9.99,
    "BUILDING": 14.99,
    "FURNITURE": 19.99,
    "HOUSEHOLD": 9.99,
}
OTHER_PRICE = 14.99

# These tables may hold more rows than 32-bit keys can number.
KEY_TYPE = "bigint"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def sales_customer(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("r_name").alias("region"),
    )


def sales_order(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast(MONEY).alias("order_total"),
        F.col("o_orderstatus").alias("order_status"),
    )


def raw_content(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        prefixed_id("CNT", key, 12).alias("content_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("section"),
        F.element_at(F.split("p_name", " "), -1).alias("content_type"),
        F.date_add(F.lit(CALENDAR.start), F.pmod(key * 7, F.lit(2400)).cast("int")).alias(
            "publish_date"
        ),
        F.concat(F.lit("Author"), F.col("p_size")).alias("author"),
        (F.col("p_size") * 50).cast("int").alias("word_count"),
    )


def raw_subscriptions(
    customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Signup at the first order; churned at the last one if it is before the cutoff.

    Customers without an order stay, with a null signup date that the silver checks count.
    """
    day = F.to_date("o_orderdate")
    spans = orders.groupBy("o_custkey").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = customer.join(spans, F.col("c_custkey") == F.col("o_custkey"), "left").join(
        places, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    gone = F.col("last") < F.lit(CHURN_CUTOFF)
    return rows.select(
        prefixed_id("SUB", F.col("c_custkey"), 12).alias("subscriber_id"),
        F.concat(F.lit("Brand#"), F.col("c_nationkey") + 1).alias("brand"),
        F.col("first").alias("signup_date"),
        F.col("c_mktsegment").alias("plan"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("channel"),
        (~gone).alias("is_active"),
        F.when(gone, F.col("last")).alias("churn_date"),
        price_of(F.col("c_mktsegment"), PRICES, OTHER_PRICE).alias("mrr"),
    )


def raw_engagement(events: DataFrame, part: DataFrame) -> DataFrame:
    """Views and errors are anonymous. Page views run from 0 to 12; zeros are invalid."""
    parts = part.agg(F.count(F.lit(1))).scalar()
    numbered = events.withColumn("content_number", F.pmod(F.col("event_id"), parts))
    rows = numbered.join(
        part.select("p_partkey", "p_brand"), F.col("content_number") == F.col("p_partkey"), "left"
    )
    known = ~F.col("event_type").isin(*ANONYMOUS)
    return rows.select(
        prefixed_id("EVT", F.col("event_id"), 12).alias("event_id"),
        F.col("ts").alias("event_timestamp"),
        F.col("p_brand").alias("brand"),
        prefixed_id("CNT", F.col("content_number"), 12).alias("content_id"),
        F.when(known, prefixed_id("SUB", F.col("user_id"), 12)).alias("subscriber_id"),
        F.col("event_type").alias("platform"),
        F.pmod(F.col("event_id"), F.lit(13)).cast("int").alias("page_views"),
        F.lit(1).alias("sessions"),
        F.floor("value").cast("int").alias("time_on_page_sec"),
    )


def raw_ad_impressions(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """About a quarter of the (order, line) ids occur more than once."""
    rows = lineitem.join(
        part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    supplier = F.concat(F.lit("Supplier "), F.col("l_suppkey"))
    price = F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))
    platform = F.element_at(
        F.array(*[F.lit(p) for p in PLATFORMS]),
        (F.pmod(F.col("l_linenumber"), F.lit(len(PLATFORMS))) + 1).cast("int"),
    )
    return rows.select(
        prefixed_id("IMP", F.col("l_orderkey") * 10 + F.col("l_linenumber"), 12).alias(
            "impression_id"
        ),
        F.col("l_shipdate").alias("impression_timestamp"),
        F.col("p_brand").alias("brand"),
        prefixed_id("CMP", F.col("l_suppkey"), 12).alias("campaign_id"),
        F.concat_ws(" ", supplier, F.col("l_returnflag"), F.lit("Campaign")).alias(
            "campaign_name"
        ),
        supplier.alias("advertiser"),
        F.col("l_returnflag").alias("channel"),
        platform.alias("platform"),
        (F.col("l_quantity") * 100).cast("int").alias("impressions"),
        F.col("l_quantity").cast("int").alias("clicks"),
        price.cast(MONEY).cast("double").alias("ad_revenue"),
    )


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = {name: table(spark, folder, name) for name in TABLES}
    return {
        "raw_content": raw_content(t["part"]),
        "raw_subscriptions": raw_subscriptions(
            t["customer"], t["orders"], t["nation"], t["region"]
        ),
        "raw_engagement": raw_engagement(t["events"], t["part"]),
        "raw_ad_impressions": raw_ad_impressions(t["lineitem"], t["part"]),
    }


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return dim_brand_from(table(spark, folder, "part"), "p_brand")


def platforms(spark: SparkSession) -> DataFrame:
    return dim_platform(spark, PLATFORMS)
