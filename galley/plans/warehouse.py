"""The sales warehouse (two tables, one view), the config store and the sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import schemas
from galley.operators.lookup import summary_per_parent
from galley.operators.quality import (
    fk_exists,
    has_columns,
    not_empty,
    rule_no_null,
    rule_non_negative,
    rule_not_empty,
    run_suite,
    summarise,
    table_checks,
    tables_exist,
    unique,
)
from galley.sources import seeds
from galley.sources.catalog import ensure_layer, ensure_table, read_table, write_table


def create_warehouse(spark: SparkSession, layer: str, location: str | None = None) -> None:
    ensure_layer(spark, layer, location)
    ensure_table(spark, layer, "customer", schemas.SALES_CUSTOMER)
    ensure_table(spark, layer, "order", schemas.SALES_ORDER)


def create_config_store(spark: SparkSession, layer: str, location: str | None = None) -> None:
    ensure_layer(spark, layer, location)
    ensure_table(spark, layer, "config", schemas.APP_CONFIG)


def sales_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, revenue and last order per customer; customers without orders stay."""
    return summary_per_parent(
        customers,
        orders,
        on=("customer_id", "customer_id"),
        keep=["customer_id", "customer_name", "region"],
        aggs={
            "total_orders": F.count("order_id"),
            "total_revenue": F.sum("order_total"),
            "last_order_date": F.max("order_date"),
        },
        zero=["total_orders"],
    )


def warehouse_checks(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return run_suite(
        [
            table_checks(customers, "customer", [rule_not_empty(), rule_no_null("customer_id")]),
            table_checks(
                orders,
                "order",
                [rule_not_empty(), rule_no_null("order_id"), rule_non_negative("order_total")],
            ),
            unique(customers, "customer", ["customer_id"]),
            unique(orders, "order", ["order_id"]),
            fk_exists(orders, "order", "customer_id", customers, "customer", "customer_id"),
        ]
    )


def config_checks(config: DataFrame) -> DataFrame:
    return run_suite([not_empty(config, "config"), unique(config, "config", ["config_key"])])


def check_warehouse(spark: SparkSession, layer: str) -> DataFrame:
    """All checks of a stored warehouse; if tables are missing, only that is reported."""
    present = tables_exist(spark, layer, ("customer", "order"))
    if summarise(present).first().failed:
        return present
    checks = warehouse_checks(
        read_table(spark, layer, "customer"), read_table(spark, layer, "order")
    )
    return present.unionByName(checks)


def check_config_store(spark: SparkSession, layer: str) -> DataFrame:
    present = tables_exist(spark, layer, ("config",))
    if summarise(present).first().failed:
        return present
    return present.unionByName(config_checks(read_table(spark, layer, "config")))


def load_sample_events(spark: SparkSession, layer: str) -> DataFrame:
    write_table(seeds.sample_events(spark), layer, "sample_events", overwrite_schema=True)
    return read_table(spark, layer, "sample_events")


def load_example_audience(spark: SparkSession, layer: str, brands: Sequence[str]) -> DataFrame:
    """In the default format of the session."""
    write_table(seeds.example_audience(spark, brands), layer, "example_audience", fmt=None)
    return read_table(spark, layer, "example_audience")


def event_checks(
    events: DataFrame,
    table: str = "sample_events",
    expected: Sequence[str] = ("event_id", "timestamp", "event_type", "user_id"),
    critical: Sequence[str] = ("event_id", "timestamp"),
) -> DataFrame:
    """An event table has rows, its expected columns, and no nulls in the critical ones.

    Critical columns that are missing are reported as missing, not as null.
    """
    there = [c for c in critical if c in events.columns]
    return run_suite(
        [
            has_columns(events, table, expected),
            table_checks(events, table, [rule_not_empty(), *[rule_no_null(c) for c in there]]),
        ]
    )
