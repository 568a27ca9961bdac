"""The whole run on generated tables, and its gate."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from galley.operators.quality import QualityError
from galley.plans import gold, pipeline, reports
from galley.session import scratch_path
from galley.sources import catalog, seeds, synthetic

BRANDS = ("Alpha", "Bravo", "Cedar", "Delta", "Ember")
CALENDAR = pipeline.Calendar(gold.CALENDAR_START, gold.CALENDAR_END)


def layers_at(spark):
    place = scratch_path(spark, "run")
    return catalog.Layers.for_stage(place.rsplit("/", 1)[-1].replace("-", "_"), location=place)


@pytest.fixture(scope="module")
def raw(spark):
    return synthetic.raw_tables(
        spark, BRANDS, subscribers=3000, events_per_day=(40, 60), ads_per_day=(10, 15)
    )


def run(spark, layers, raw):
    return pipeline.run(
        spark, layers, raw, CALENDAR, seeds.dim_brand(spark, BRANDS), seeds.dim_platform(spark)
    )


def test_run_builds_and_checks_everything(spark, raw):
    layers = layers_at(spark)
    counted = {(r.layer.rsplit("_", 1)[-1], r.table): r.rows for r in run(spark, layers, raw).collect()}
    assert counted["gold", "dim_date"] == 456
    assert counted["gold", "dim_content"] == 2000
    assert counted["gold", "fct_subscription"] == 3000
    assert counted["gold", "fct_engagement"] == counted["bronze", "raw_engagement"]
    assert counted["gold", "fct_ad"] == counted["silver", "silver_ad_impressions"]

    model = pipeline.load_model(spark, layers, CALENDAR)
    assert [r.month_name for r in reports.page_views_by_month(model).collect()] == [
        "March", "April", "May", "June",
    ]

    checks = pipeline.check_gold(spark, layers, CALENDAR)
    assert checks.where("NOT passed").count() == 0 and checks.count() == 9 + 52 + 9 + 9

    snapshot = pipeline.load_snapshot(spark, layers, CALENDAR, date(2026, 5, 31))
    tables = {**model.tables, pipeline.SNAPSHOT: snapshot}
    assert pipeline.snapshot_checks(tables).where("NOT passed").count() == 0
    day = reports.active_on(snapshot, date(2026, 4, 15), CALENDAR.start)
    assert day.agg(F.sum("subscribers")).first()[0] > 0
    assert reports.mrr_by_month(snapshot).count() >= 3

    # a second run replaces the tables
    assert run(spark, layers, raw).where("table = 'fct_ad'").first().rows == counted["gold", "fct_ad"]


def test_run_stops_at_the_first_failing_layer(spark, raw):
    layers = layers_at(spark)
    empty = {**raw, "raw_content": raw["raw_content"].limit(0)}
    with pytest.raises(QualityError, match="not_empty raw_content"):
        run(spark, layers, empty)
    assert not catalog.exists(spark, layers.silver, "silver_content")


def test_gold_gate_names_the_faulty_relationship(spark, raw):
    layers = layers_at(spark)
    bad = raw["raw_ad_impressions"].withColumn("brand", F.lit("Nowhere"))
    with pytest.raises(QualityError, match="no_nulls fct_ad.brand_key"):
        run(spark, layers, {**raw, "raw_ad_impressions": bad})


def test_check_gold_reports_missing_tables(spark):
    layers = layers_at(spark)
    catalog.ensure_layers(spark, layers)
    catalog.write_table(gold.dim_date(spark), layers.gold, "dim_date")
    missing = pipeline.check_gold(spark, layers, CALENDAR).where("NOT passed")
    assert missing.count() == 8 and missing.where("check = 'exists'").count() == 8
