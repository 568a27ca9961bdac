from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galley.plans import gold, pipeline, reports
from galley.plans.measures import (
    MEASURES,
    RECONCILED,
    RELATIONSHIPS,
    SUMMARIZE_BY,
    StarModel,
    displayed,
    measure,
)

START = date(2026, 1, 1)


def key(month, day=1):
    return gold.date_key_of(date(2026, month, day), START)


@pytest.fixture(scope="module")
def model(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "dim_date": gold.dim_date(spark, START, date(2026, 12, 31)),
        "dim_brand": table([(1, "Alpha"), (2, "Bravo")], "brand_key int, brand_name string"),
        "dim_content": table(
            [(1, "C1", "one", "Food"), (2, "C2", "two", "Home"), (3, "C3", "three", "Food")],
            "content_key int, content_id string, title string, section string",
        ),
        "dim_subscriber": table(
            [(1, "email"), (2, "direct"), (3, "email")],
            "subscriber_key int, acquisition_channel string",
        ),
        "dim_platform": table([(1, "web"), (2, "ios")], "platform_key int, platform_name string"),
        "dim_campaign": table(
            [(1, "CMP1", "first"), (2, "CMP2", "second")],
            "campaign_key int, campaign_id string, campaign_name string",
        ),
        "fct_engagement": table(
            [
                (key(1), 1, 1, 1, 1, 5, 1, 50),
                (key(1, 2), 1, 2, 1, 1, 7, 1, 70),
                (key(2), 1, 3, 2, 2, 1, 1, 10),
                (key(2), None, None, None, 2, 4, 1, 40),
                (key(5), 2, 1, None, 1, 2, 1, 20),
            ],
            "date_key int, brand_key int, content_key int, subscriber_key int, platform_key int, "
            "page_views int, sessions int, time_on_page_sec int",
        ),
        "fct_subscription": table(
            [
                (key(1), 1, 1, 1, 1, 0, Decimal("9.99")),
                (key(1), 1, 2, 0, 1, 1, Decimal("14.99")),
                (key(4), 2, 3, 1, 1, 0, Decimal("19.99")),
                # the same subscriber twice: counted once where distinct
                (key(5), 2, 3, 1, 0, 0, Decimal("19.99")),
            ],
            "date_key int, brand_key int, subscriber_key int, active_flag int, new_flag int, "
            "churned_flag int, mrr decimal(18,2)",
        ),
        "fct_ad": table(
            [
                (key(1), 1, 1, 1, 1000, 10, Decimal("5.00")),
                (key(2), 1, 2, 2, 500, 20, Decimal("7.50")),
                (key(5), 2, 1, 2, 0, 0, Decimal("0.00")),
            ],
            "date_key int, brand_key int, campaign_key int, platform_key int, impressions int, "
            "clicks int, ad_revenue decimal(18,2)",
        ),
    }
    return StarModel(tables, START)


EXPECTED = {
    "Page Views": 19.0,
    "Sessions": 5.0,
    "Avg Time on Page (sec)": 38.0,
    "Active Subscribers": 2.0,
    "New Subscribers": 3.0,
    "Churned Subscribers": 1.0,
    "Churn Rate %": 50.0,
    "MRR": 64.96,
    "ARPU": 32.48,
    "Ad Revenue": 12.5,
    "Ad Impressions": 1500.0,
    "Ad Clicks": 30.0,
    "CTR %": 2.0,
    "eCPM": 12.5 / 1500 * 1000,
    "New Subscriber Growth %": 150.0,
}


@pytest.mark.parametrize("title", EXPECTED)
def test_totals(model, title):
    row = model.evaluate(title).first()
    assert (row.measure, row.value) == (title, EXPECTED[title])


@pytest.mark.parametrize("title", EXPECTED)
def test_an_empty_slice_is_zero(model, title):
    empty = StarModel({n: t.limit(0) for n, t in model.tables.items()}, START)
    assert empty.evaluate(title).first().value == 0.0


def test_registry_has_the_fifteen_measures():
    assert set(EXPECTED) <= {m.title for m in MEASURES.values()}
    assert measure("eCPM").name == "ecpm"
    with pytest.raises(KeyError):
        measure("nothing")


@pytest.mark.parametrize("by", ["dim_brand.brand_name", "dim_content.section", "dim_date.month", "dim_subscriber.acquisition_channel"])
def test_groups_of_additive_measures_add_up(model, by):
    rows = model.query(["page_views", "sessions"], [by]).collect()
    assert sum(r.page_views for r in rows) == 19 and sum(r.sessions for r in rows) == 5


def test_rows_without_a_dimension_row_stay_under_null(model, rows):
    assert rows(model.query(["page_views"], ["dim_brand.brand_name"])) == sorted(
        [("Alpha", 13), ("Bravo", 2), (None, 4)], key=repr
    )


def test_distinct_counts_do_not_add_up(model, rows):
    by_month = model.query(["active_subscribers"], ["dim_date.month"])
    assert rows(by_month) == [(1, 1), (4, 1), (5, 1)]
    assert rows(reports.monthly_active_users(model), "month", "active_users") == [(1, 1), (2, 1), (5, 0)]


def test_slice_by_period_and_dimension(model, rows):
    out = model.query(
        ["page_views"],
        ["dim_content.section"],
        where={"dim_brand": F.col("brand_name") == "Alpha"},
        period=(date(2026, 1, 1), date(2026, 1, 31)),
    )
    assert rows(out) == [("Food", 5), ("Home", 7)]


def test_slice_on_the_fact_itself(model):
    assert model.query(["page_views"], where={"fct_engagement": F.col("page_views") > 4}).first()[0] == 12


def test_a_period_reaches_the_scan_as_a_key_range(model):
    plan = model.query(["page_views"], period=(date(2026, 1, 2), date(2026, 1, 31)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2" in text and "<= 31" in text and "Join" not in text


def test_additive_measures_are_grouped_before_the_join(model):
    text = model.query(["page_views"], ["dim_content.section"])._jdf.queryExecution().optimizedPlan().toString()
    join = text.index("Join LeftOuter")
    assert "Aggregate [content_key" in text[join:]


def test_unrelated_dimension_is_refused(model):
    with pytest.raises(ValueError, match="dim_campaign does not filter fct_engagement"):
        model.query(["page_views"], ["dim_campaign.campaign_name"])


def test_clashing_group_names_are_refused(model):
    with pytest.raises(ValueError, match="share a name"):
        model.query(["page_views"], ["dim_brand.brand_key", "dim_content.brand_key"])


def test_drill_across(model, rows):
    assert rows(reports.audience_and_ads_by_brand(model)) == sorted(
        [
            ("Alpha", 13, 2, Decimal("24.98"), Decimal("12.50")),
            ("Bravo", 2, 1, Decimal("39.98"), Decimal("0.00")),
            (None, 4, None, None, None),
        ],
        key=repr,
    )


def test_measures_of_several_facts_without_groups(model):
    row = model.query(["page_views", "mrr", "ctr_pct"]).first()
    assert tuple(row) == (19, Decimal("64.96"), 2.0)


def test_relate(model):
    assert model.relate("fct_ad", "dim_campaign").where("campaign_id = 'CMP1'").count() == 2


def test_last_day(model):
    assert model.last_day("fct_engagement") == date(2026, 5, 1)


def test_reports(model, rows):
    as_of = date(2026, 2, 15)
    assert rows(reports.card(model, "mrr")) == [("MRR", 64.96)]
    assert [r.month_name for r in reports.page_views_by_month(model).collect()] == ["January", "February", "May"]
    assert rows(reports.new_and_churned_by_month(model)) == [
        (2026, 1, "January", 2, 1),
        (2026, 4, "April", 1, 0),
        (2026, 5, "May", 0, 0),
    ]
    assert [r.brand_name for r in reports.top_brands(model).collect()] == ["Alpha", None, "Bravo"]
    assert tuple(reports.brand_churn_rate(model, "Alpha", date(2026, 1, 9)).first()) == (1, 1, 100.0)
    assert [tuple(r) for r in reports.top_sections(model, as_of, 2).collect()] == [("Home", 7), ("Food", 6)]
    assert rows(reports.mrr_trend(model, date(2026, 5, 3), 2), "month", "mrr") == [
        (4, Decimal("19.99")),
        (5, Decimal("19.99")),
    ]
    assert [tuple(r) for r in reports.ecpm_by_platform(model).collect()] == [("ios", 15.0), ("web", 5.0)]
    assert rows(reports.new_subscribers_by_channel(model, 2026)) == [("direct", 1), ("email", 1)]
    assert [r.brand_name for r in reports.brands_by_arpu(model).collect()] == ["Bravo", "Alpha"]
    assert [(r.brand_name, r.month) for r in reports.churn_by_brand_and_month(model).collect()] == [
        ("Bravo", 5),
        ("Bravo", 4),
        ("Alpha", 1),
    ]
    assert reports.best_ecpm_brand(model, date(2026, 4, 1)).first().brand_name == "Alpha"
    assert tuple(reports.brand_growth(model, "Alpha").first()) == (2, 1, 200.0)
    assert reports.page_views_by_brand(model).count() == 3
    assert rows(reports.churn_by_brand(model)) == [("Alpha", 100.0), ("Bravo", 0.0)]
    assert rows(reports.mrr_by_brand(model)) == [("Alpha", Decimal("24.98")), ("Bravo", Decimal("39.98"))]
    assert reports.top_content(model, 1).first().page_views == 7
    assert reports.ad_revenue_by_campaign(model).first().campaign_id == "CMP2"


def test_periods():
    d = date(2026, 2, 15)
    assert reports.month_of(d) == (date(2026, 2, 1), date(2026, 2, 28))
    assert reports.quarter_of(d) == (date(2026, 1, 1), date(2026, 3, 31))
    assert reports.previous_quarter(d) == (date(2025, 10, 1), date(2025, 12, 31))
    assert reports.last_months(d, 6) == (date(2025, 9, 1), date(2026, 2, 28))
    assert reports.first_quarter(2024) == (date(2024, 1, 1), date(2024, 3, 31))


def test_displayed(model):
    row = displayed(model.query(["mrr", "churn_rate_pct"]), ["mrr", "churn_rate_pct"]).first()
    assert (row.mrr_text, row.churn_rate_pct_text) == ("$65", "50.00%")


def test_every_reconciled_measure_agrees(model):
    compared = pipeline.reconciliation(model).collect()
    assert len(compared) == len(RECONCILED) and all(r.passed for r in compared)


def test_default_aggregation_per_column():
    assert SUMMARIZE_BY["fct_subscription"] == {
        "date_key": "none", "brand_key": "none", "subscriber_key": "none", "mrr": "sum",
        "active_flag": "none", "new_flag": "none", "churned_flag": "none",
    }
    assert sum(len(d) for d in RELATIONSHIPS.values()) == 12
