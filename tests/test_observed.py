"""Checks that are gathered by the write itself."""

import pytest
from pyspark.sql import functions as F

from galley.operators import quality as q
from galley.plans import gold, pipeline
from galley.session import scratch_path
from galley.sources import catalog, seeds, synthetic

BRANDS = ("Alpha", "Bravo", "Cedar")
CALENDAR = pipeline.Calendar(gold.CALENDAR_START, gold.CALENDAR_END)


def layers_at(spark):
    place = scratch_path(spark, "observed")
    return catalog.Layers.for_stage(place.rsplit("/", 1)[-1].replace("-", "_"), location=place)


def faulty(spark, n=1000):
    k = F.col("id")
    return spark.range(n).select(
        F.when(k % 7 != 0, k).alias("k"), (k - 3).alias("v"), F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(k).alias("d"),
        (k % 5).alias("part"),
    )


def rules():
    return [q.rule_not_empty(), q.rule_no_null("k"), q.rule_non_negative("v"), q.rule_non_negative("d"),
            q.rule_expect("k<500", F.col("k") < 500)]


@pytest.mark.parametrize("layout", [{}, {"partition_by": ["part"]}, {"partition_by": ["part"], "cluster_by": ["v"]}, {"cluster_by": ["v"]}])
@pytest.mark.parametrize("n", [1000, 0])
def test_observed_rows_equal_those_of_a_scan(spark, rows, layout, n):
    layers = layers_at(spark)
    catalog.ensure_layers(spark, layers)
    seen = q.Observed("t", rules(), {"total": F.sum("v")})
    catalog.write_table(faulty(spark, n), layers.gold, "t", watch=seen.watch, **layout)
    written = catalog.read_table(spark, layers.gold, "t")
    assert rows(seen.checks(spark)) == rows(q.table_checks(written, "t", rules()))
    assert seen.rows == n and seen.figures == {"total": sum(range(-3, 997)) if n else None}


def test_clustered_files_stay_sorted(spark):
    layers = layers_at(spark)
    catalog.ensure_layers(spark, layers)
    seen = q.Observed("t", rules())
    catalog.write_table(faulty(spark).orderBy(F.rand(1)), layers.gold, "t", watch=seen.watch, partition_by=["part"], cluster_by=["v"])
    for path in catalog.read_table(spark, layers.gold, "t").inputFiles():
        values = [r.v for r in spark.read.parquet(path).collect()]
        assert values == sorted(values) and len(values) > 1


def test_rules_on_distinct_values_are_left_to_a_scan(spark, rows):
    days = gold.dim_date(spark).where("day <> 5")
    seen = q.Observed("dim_date", [q.rule_not_empty(), q.rule_no_gaps("full_date")])
    seen.watch(days).write.format("noop").mode("overwrite").save()
    assert rows(seen.checks(spark, days)) == rows(q.table_checks(days, "dim_date", [q.rule_not_empty(), q.rule_no_gaps("full_date")]))
    with pytest.raises(ValueError, match="need a scan"):
        seen.checks(spark)


def test_a_build_that_was_watched_has_the_same_checks(spark, rows):
    layers = layers_at(spark)
    catalog.ensure_layers(spark, layers)
    raw = synthetic.raw_tables(spark, BRANDS, subscribers=500, events_per_day=(10, 20), ads_per_day=(5, 9))
    seen: pipeline.Seen = {}
    pipeline.load_bronze(spark, layers, raw, seen)
    pipeline.build_silver(spark, layers, seen=seen)
    pipeline.build_gold(spark, layers, CALENDAR, seeds.dim_brand(spark, BRANDS), seeds.dim_platform(spark), seen=seen)
    bronze = {t: catalog.read_table(spark, layers.bronze, t) for t in pipeline.BRONZE_TABLES}
    assert rows(q.run_suite([seen[t].checks(spark) for t in bronze])) == rows(pipeline.bronze_checks(bronze))
    assert rows(pipeline.check_gold(spark, layers, CALENDAR, seen=seen)) == rows(pipeline.check_gold(spark, layers, CALENDAR))
    silver = {t: catalog.read_table(spark, layers.silver, t) for t in pipeline.SILVER_TABLES}
    model = pipeline.load_model(spark, layers, CALENDAR)
    same = [q.same_rows(seen[s], seen[f], f"{s}->{f}") for f, s in pipeline.SOURCES.items()]
    assert rows(q.run_suite(same)) == rows(pipeline.row_count_checks(silver, model.tables))

    # facts are read once for links and once for measures, and no more
    plan = pipeline.check_gold(spark, layers, CALENDAR, seen=seen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{layers.gold}.fct_ad") + plan.count(f"{layers.gold}`.`fct_ad") <= 2


def test_a_table_that_changed_after_its_write_fails_the_reconciliation(spark):
    layers = layers_at(spark)
    catalog.ensure_layers(spark, layers)
    raw = synthetic.raw_tables(spark, BRANDS, subscribers=300, events_per_day=(10, 20), ads_per_day=(5, 9))
    seen: pipeline.Seen = {}
    pipeline.load_bronze(spark, layers, raw)
    pipeline.build_silver(spark, layers)
    pipeline.build_gold(spark, layers, CALENDAR, seeds.dim_brand(spark, BRANDS), seeds.dim_platform(spark), seen=seen)
    model = pipeline.load_model(spark, layers, CALENDAR)
    ads = model.tables["fct_ad"].withColumn("clicks", F.col("clicks") * 2)
    lost = pipeline.StarModel({**model.tables, "fct_ad": ads}, CALENDAR.start)
    failed = pipeline.observed_reconciliation(lost, seen).where("NOT passed")
    assert [r.measure for r in failed.collect()] == ["Ad Clicks"]
