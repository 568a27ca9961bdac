"""Stored roll-ups: equal to the facts under every slice they cover, and used only then."""

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from galley.operators import bitmaps
from galley.plans import gold, reports, rollups
from galley.plans.measures import StarModel
from galley.plans.rollups import BITMAP_KEYS, LEVELS

START = date(2026, 1, 1)
END = date(2026, 12, 31)


@pytest.fixture(scope="module")
def model(spark):
    """Facts of hashed rows, with null keys, users of several buckets and groups without users."""
    def draw(salt, n):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def nullable(column, salt):
        return F.when(draw(salt, 10) > 0, column)

    rows = spark.range(4000)
    day = nullable(draw(1, 365) + 1, 2)
    engagement = rows.select(
        day.alias("date_key"), nullable(draw(3, 4) + 1, 4).alias("brand_key"), (draw(5, 30) + 1).alias("content_key"),
        F.when(draw(3, 4) != 2, nullable(draw(6, 90) * 1000 + 1, 7)).alias("subscriber_key"),
        nullable(draw(8, 3) + 1, 9).alias("platform_key"), draw(10, 12).alias("page_views"), F.lit(1).alias("sessions"),
        draw(11, 300).alias("time_on_page_sec"),
    )
    subscription = rows.where("id < 900").select(
        day.alias("date_key"), nullable(draw(3, 4) + 1, 4).alias("brand_key"), (F.col("id") * 40 + 1).cast("int").alias("subscriber_key"),
        F.when(draw(3, 4) != 1, draw(12, 2)).otherwise(0).alias("active_flag"), F.lit(1).alias("new_flag"),
        (1 - draw(12, 2)).alias("churned_flag"), F.lit(Decimal("9.99")).cast("decimal(18,2)").alias("mrr"),
    )
    ads = rows.select(
        day.alias("date_key"), nullable(draw(3, 4) + 1, 4).alias("brand_key"), (draw(13, 20) + 1).alias("campaign_key"),
        nullable(draw(8, 3) + 1, 9).alias("platform_key"), draw(14, 500).alias("impressions"), draw(15, 9).alias("clicks"),
        (draw(16, 100) / 4).cast("decimal(18,2)").alias("ad_revenue"),
    )
    brands = spark.createDataFrame([(k, f"B{k}") for k in range(1, 5)], "brand_key int, brand_name string")
    platforms = spark.createDataFrame([(k, f"P{k}") for k in range(1, 4)], "platform_key int, platform_name string")
    content = spark.range(1, 31).select(
        F.col("id").cast("int").alias("content_key"), F.concat(F.lit("C"), "id").alias("content_id"),
        F.concat(F.lit("S"), F.col("id") % 4).alias("section"), F.lit("t").alias("title"),
    )
    campaigns = spark.range(1, 21).select(
        F.col("id").cast("int").alias("campaign_key"), F.concat(F.lit("K"), "id").alias("campaign_id"),
        F.lit("n").alias("campaign_name"),
    )
    facts = {
        f: gold.with_month(df, START).cache()
        for f, df in {"fct_engagement": engagement, "fct_subscription": subscription, "fct_ad": ads}.items()
    }
    return StarModel(
        {"dim_date": gold.dim_date(spark, START, END), "dim_brand": brands, "dim_platform": platforms,
         "dim_content": content, "dim_campaign": campaigns, **facts}, START,
    )


@pytest.fixture(scope="module")
def stored(model):
    sums = {f: rollups.rolled_up(model.tables[f], f).cache() for f in LEVELS}
    sets = {f: rollups.month_bitmaps(model.tables[f], f).cache() for f in BITMAP_KEYS}
    sizes = {(r.fact, r.level): r["rows"] for r in rollups.level_sizes(sums).collect()}
    return replace(model, rollups=rollups.Rollups(sums, sets, sizes))


EVERY = ["page_views", "avg_time_on_page_sec", "active_users"]
SUBSCRIBERS = ["active_subscribers", "churn_rate_pct", "mrr", "arpu", "new_subscriber_growth_pct"]
ADS = ["ad_revenue", "ad_impressions", "ctr_pct", "ecpm"]
BRAND, PLATFORM = "dim_brand.brand_name", "dim_platform.platform_name"
QUARTER = (date(2026, 4, 1), date(2026, 6, 30))

COVERED = {
    "total": (EVERY + SUBSCRIBERS + ADS, {}),
    "brand": (EVERY + SUBSCRIBERS + ADS, {"by": [BRAND]}),
    "months": (EVERY + SUBSCRIBERS + ADS, {"by": reports.MONTHS}),
    "quarters": (EVERY + ADS, {"by": ["dim_date.year", "dim_date.quarter"]}),
    "brand and platform": (EVERY + ADS, {"by": [BRAND, PLATFORM]}),
    "quarter": (EVERY + SUBSCRIBERS + ADS, {"by": [BRAND], "period": QUARTER}),
    "some months": (EVERY, {"by": [PLATFORM], "where": {"dim_date": "month IN (2, 3, 9)"}}),
    "one brand": (EVERY + SUBSCRIBERS, {"where": {"dim_brand": "brand_name = 'B2'"}}),
    "no such month": (EVERY, {"where": {"dim_date": "month = 13"}}),
    "sections": (["page_views"], {"by": ["dim_content.section"], "period": QUARTER}),
    "campaigns": (ADS, {"by": ["dim_campaign.campaign_id"]}),
    "campaigns of a platform": (ADS, {"by": ["dim_campaign.campaign_id"], "where": {"dim_platform": "platform_name <> 'P1'"}}),
}
UNCOVERED = {
    "half a month": (EVERY, {"period": (date(2026, 4, 1), date(2026, 4, 20))}),
    "weekends": (EVERY, {"where": {"dim_date": "is_weekend"}}),
    "days": (["page_views"], {"by": ["dim_date.full_date"]}),
    "users of a section": (["active_users"], {"by": ["dim_content.section"]}),
    "rows": (["page_views"], {"where": {"fct_engagement": "page_views > 5"}}),
}


def _slice(slice_):
    return {**slice_, "where": {t: F.expr(c) for t, c in slice_.get("where", {}).items()}}


def _rows(df):
    def plain(value):
        return value if value is None or isinstance(value, (str, date)) else round(float(value), 9)

    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [*COVERED, *UNCOVERED])
def test_roll_ups_equal_the_facts(model, stored, name):
    wanted, slice_ = {**COVERED, **UNCOVERED}[name]
    slice_ = _slice(slice_)
    assert _rows(stored.query(wanted, **slice_)) == _rows(model.query(wanted, **slice_))


@pytest.mark.parametrize("name", COVERED)
def test_covered_questions_do_not_touch_a_fact(stored, name):
    wanted, slice_ = COVERED[name]
    bare = replace(stored, tables={t: df for t, df in stored.tables.items() if not t.startswith("fct_")})
    bare.query(wanted, **_slice(slice_)).collect()


def test_uncovered_questions_need_the_fact(stored):
    bare = replace(stored, tables={t: df for t, df in stored.tables.items() if not t.startswith("fct_")})
    for wanted, slice_ in UNCOVERED.values():
        with pytest.raises(KeyError):
            bare.query(wanted, **_slice(slice_))


def test_the_smallest_level_answers(stored):
    r = stored.rollups
    assert LEVELS["fct_engagement"][r.level_for("fct_engagement", set())] == ()
    assert LEVELS["fct_engagement"][r.level_for("fct_engagement", {"brand_key"})] == ("brand_key",)
    assert LEVELS["fct_engagement"][r.level_for("fct_engagement", {"date_month", "platform_key"})][1] == "brand_key"
    assert r.level_for("fct_engagement", {"subscriber_key"}) is None


def test_levels_are_told_apart_from_null_keys(stored):
    rows = stored.rollups.sums["fct_engagement"]
    totals = {r.level: (r["rows"], r.groups) for r in rows.groupBy("level").agg(F.sum("rows").alias("rows"), F.count("*").alias("groups")).collect()}
    assert {n for n, _ in totals.values()} == {4000} and totals[6][1] == 1
    assert len(totals) == len(LEVELS["fct_engagement"])


def test_bitmaps_of_odd_keys(spark):
    rows = [("a", 1), ("a", 1), ("a", 32768), ("a", 32769), ("a", None), ("b", None), ("c", 2**40), ("c", 1), (None, 5)]
    frame = spark.createDataFrame(rows, "g string, k long")
    held = bitmaps.key_bitmaps(frame, F.col("k"), ["g"])
    assert {tuple(r) for r in bitmaps.counted(held, ["g"], "n").collect()} == {("a", 3), ("b", 0), ("c", 2), (None, 1)}
    assert bitmaps.counted(held, [], "n").first().n == 5
    assert bitmaps.counted(held.limit(0), [], "n").first().n == 0
    assert bitmaps.merged(held, []).count() == 4  # three buckets, and that of rows without a key
    cube = {(r.g, r.level): r.n for r in bitmaps.counted_sets(held, [["g"], []], "n").collect()}
    assert cube == {("a", 0): 3, ("b", 0): 0, ("c", 0): 2, (None, 0): 1, (None, 1): 5}


def test_a_distinct_measure_is_reduced_before_the_join(model):
    """The rows that meet the dimension are distinct combinations, not rows of the fact."""
    plan = model.query(["active_users"], [BRAND])._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert "Aggregate [brand_key" in plan[join:]


def test_the_finest_level_is_not_expanded(model):
    """Its groups may be as many as rows; they are aggregated once and moved no further."""
    plan = rollups.rolled_up(model.tables["fct_ad"], "fct_ad")._jdf.queryExecution().optimizedPlan().toString()
    expand = next(line for line in plan.splitlines() if "Expand [[" in line)
    projections = expand[expand.index("[[") + 1 : expand.index("]]")].split("], [")
    assert len(projections) == len(LEVELS["fct_ad"]) - 1
