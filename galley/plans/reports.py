"""Report visuals and sample questions, each one call of the measure layer.

Periods that are relative ("last month", "this quarter") take an ``as_of`` day, so that a
question has the same answer whenever it is asked; ``StarModel.last_day`` gives the latest
day with data.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators.intervals import on_days
from galley.plans.measures import StarModel

MONTHS = ["dim_date.year", "dim_date.month", "dim_date.month_name"]


def _months_in_order() -> list:
    return [F.col("year").asc_nulls_first(), F.col("month").asc_nulls_first()]


def _descending(name: str):
    return F.col(name).desc_nulls_last()


def _brand(name: str) -> dict:
    return {"dim_brand": F.col("brand_name") == name}


# --- periods ----------------------------------------------------------------------------


def _month_start(day: date, back: int = 0) -> date:
    months = day.year * 12 + day.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def month_of(day: date) -> tuple[date, date]:
    return _month_start(day), _month_start(day, -1) - timedelta(days=1)


def quarter_of(day: date) -> tuple[date, date]:
    start = _month_start(day, (day.month - 1) % 3)
    return start, _month_start(start, -3) - timedelta(days=1)


def last_months(day: date, n: int) -> tuple[date, date]:
    """The month of the day and the n - 1 before it."""
    return _month_start(day, n - 1), month_of(day)[1]


def previous_quarter(day: date) -> tuple[date, date]:
    return quarter_of(quarter_of(day)[0] - timedelta(days=1))


def first_quarter(year: int) -> tuple[date, date]:
    return quarter_of(date(year, 1, 1))


# --- report visuals ---------------------------------------------------------------------


def card(model: StarModel, measure: str) -> DataFrame:
    """One number."""
    return model.evaluate(measure)


def page_views_by_month(model: StarModel) -> DataFrame:
    return model.query(["page_views"], MONTHS, order_by=_months_in_order())


def new_and_churned_by_month(model: StarModel) -> DataFrame:
    return model.query(
        ["new_subscribers", "churned_subscribers"], MONTHS, order_by=_months_in_order()
    )


def top_brands(model: StarModel) -> DataFrame:
    return model.query(
        ["page_views"], ["dim_brand.brand_name"], order_by=[_descending("page_views")]
    )


# --- sample questions -------------------------------------------------------------------


def brand_churn_rate(model: StarModel, brand: str, as_of: date) -> DataFrame:
    """Churn rate of one brand in the month of ``as_of``."""
    return model.query(
        ["churned_subscribers", "active_subscribers", "churn_rate_pct"],
        where=_brand(brand),
        period=month_of(as_of),
    )


def top_sections(model: StarModel, as_of: date, n: int = 5) -> DataFrame:
    """Sections with the most page views in the quarter of ``as_of``."""
    return model.query(
        ["page_views"],
        ["dim_content.section"],
        period=quarter_of(as_of),
        order_by=[_descending("page_views")],
        limit=n,
    )


def mrr_trend(model: StarModel, as_of: date, months: int = 6) -> DataFrame:
    return model.query(
        ["mrr"], MONTHS, period=last_months(as_of, months), order_by=_months_in_order()
    )


def ecpm_by_platform(model: StarModel) -> DataFrame:
    return model.query(["ecpm"], ["dim_platform.platform_name"], order_by=[_descending("ecpm")])


def new_subscribers_by_channel(model: StarModel, year: int) -> DataFrame:
    """New subscribers by acquisition channel in the first quarter."""
    return model.query(
        ["new_subscribers"],
        ["dim_subscriber.acquisition_channel"],
        period=first_quarter(year),
        order_by=[_descending("new_subscribers")],
    )


def active_on(snapshot: DataFrame, day: date, calendar_start: date) -> DataFrame:
    """``(brand_key, subscribers, active, mrr)`` on one day; reads the files of its month only."""
    key = (day - calendar_start).days + 1
    rows = snapshot.where((F.col("date_month") == day.year * 100 + day.month) & (F.col("date_key") == key))
    return rows.groupBy("brand_key").agg(
        F.count(F.lit(1)).alias("subscribers"), F.sum("active_flag").alias("active"), F.sum("mrr").alias("mrr")
    )


def mrr_by_month(snapshot: DataFrame) -> DataFrame:
    """``(date_month, subscribers, mrr)`` on the last day of each month in the snapshot.

    Days are added up first, so what meets per month is a row per day.
    """
    daily = snapshot.groupBy("date_month", "date_key").agg(
        F.count(F.lit(1)).alias("subscribers"), F.sum("mrr").alias("mrr")
    )
    last = F.max_by(F.struct("subscribers", "mrr"), "date_key")
    return daily.groupBy("date_month").agg(last.alias("last")).select("date_month", "last.*")


def stays_on(stays: DataFrame, day: date, calendar_start: date) -> DataFrame:
    """``active_on`` from stays: a filter, as no stay is expanded."""
    key = (day - calendar_start).days + 1
    inside = stays.where(F.lit(key).between(F.col("from_key"), F.col("to_key")))
    left = F.coalesce(F.col("churn_key") == key, F.lit(False))
    return inside.groupBy("brand_key").agg(
        F.count(F.lit(1)).alias("subscribers"), F.count_if(~left).alias("active"), F.sum("mrr").alias("mrr")
    )


def stays_by_month(stays: DataFrame, dates: DataFrame, data_end: date) -> DataFrame:
    """``mrr_by_month`` from stays: they meet the last days of the months, and no other days."""
    ends = (
        dates.where(F.col("full_date") <= F.lit(data_end))
        .groupBy((F.col("year") * 100 + F.col("month")).alias("date_month"))
        .agg(F.max("date_key").alias("date_key"))
    )
    return (
        on_days(stays, ends, "date_key", "from_key", "to_key")
        .groupBy("date_month")
        .agg(F.count(F.lit(1)).alias("subscribers"), F.sum("mrr").alias("mrr"))
    )


def brands_by_arpu(model: StarModel) -> DataFrame:
    return model.query(["arpu"], ["dim_brand.brand_name"], order_by=[_descending("arpu")])


def churn_by_brand_and_month(model: StarModel) -> DataFrame:
    """Latest month first. The month name alone would merge years, so the year is kept."""
    return model.query(
        ["churned_subscribers", "active_subscribers", "churn_rate_pct"],
        ["dim_brand.brand_name", *MONTHS],
        order_by=[_descending("year"), _descending("month")],
    )


def best_ecpm_brand(model: StarModel, as_of: date) -> DataFrame:
    """Brand with the highest eCPM in the quarter before that of ``as_of``."""
    return model.query(
        ["ecpm"],
        ["dim_brand.brand_name"],
        period=previous_quarter(as_of),
        order_by=[_descending("ecpm")],
        limit=1,
    )


def brand_growth(model: StarModel, brand: str) -> DataFrame:
    return model.query(
        ["new_subscribers", "active_subscribers", "new_subscriber_growth_pct"],
        where=_brand(brand),
    )


def page_views_by_brand(model: StarModel) -> DataFrame:
    return model.query(["page_views"], ["dim_brand.brand_name"])


def monthly_active_users(model: StarModel) -> DataFrame:
    """Distinct subscribers with engagement in the month."""
    return model.query(["active_users"], MONTHS, order_by=_months_in_order())


def churn_by_brand(model: StarModel) -> DataFrame:
    return model.query(
        ["churn_rate_pct"], ["dim_brand.brand_name"], order_by=[_descending("churn_rate_pct")]
    )


def mrr_by_brand(model: StarModel) -> DataFrame:
    return model.query(["mrr"], ["dim_brand.brand_name"], order_by=[_descending("mrr")])


def top_content(model: StarModel, n: int = 10) -> DataFrame:
    return model.query(
        ["page_views"],
        ["dim_content.content_id", "dim_content.title"],
        order_by=[_descending("page_views")],
        limit=n,
    )


def ad_revenue_by_campaign(model: StarModel) -> DataFrame:
    return model.query(
        ["ad_revenue"],
        ["dim_campaign.campaign_id", "dim_campaign.campaign_name"],
        order_by=[_descending("ad_revenue")],
    )


def audience_and_ads_by_brand(model: StarModel) -> DataFrame:
    """All three facts side by side."""
    return model.query(
        ["page_views", "new_subscribers", "mrr", "ad_revenue"],
        ["dim_brand.brand_name"],
        order_by=[F.col("brand_name").asc_nulls_first()],
    )


# --- plain aggregates -------------------------------------------------------------------


def top_event_types(events: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent event types; equal counts by name."""
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "event_type")
        .limit(n)
    )
