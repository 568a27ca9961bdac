"""SQL functions give what the measure layer gives."""

import pytest
from pyspark.sql import functions as F

from entrypoints.star import star
from galley.plans import sql_measures
from galley.plans.measures import MEASURES, RELATIONSHIPS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    held = star(spark, FOLDER)
    sql_measures.register(spark, held.layers.gold)
    return held.model


def rounded(rows):
    return sorted(tuple(v if isinstance(v, (str, type(None))) else round(float(v), 6) for v in r) for r in rows)


@pytest.mark.parametrize("fact", RELATIONSHIPS)
def test_every_measure_by_every_attribute(spark, model, fact):
    names = [*sql_measures.bases(fact), *sql_measures.ratios(fact)]
    for attribute, (dim, text) in sql_measures.attributes(fact).items():
        got = spark.sql(f"SELECT label, {', '.join(names)} FROM {fact}_measures('{attribute}')")
        if attribute == "month":
            want = model.query(names, ["dim_date.year", "dim_date.month"]).select(F.expr(text).alias("label"), *names)
        else:
            want = model.query(names, [f"{dim}.{'year' if attribute == 'year' else text}"]).select(F.col("year" if attribute == "year" else text).cast("string"), *names)
        assert rounded(map(lambda r: tuple("-" if v is None else v for v in r), got.collect())) == rounded(
            map(lambda r: tuple("-" if v is None else v for v in r), want.collect())
        ), attribute
    total = spark.sql(f"SELECT {', '.join(names)} FROM {fact}_measures('total')")
    assert rounded(total.collect()) == rounded(model.query(names).collect())
    assert spark.sql(f"SELECT * FROM {fact}_measures('no such attribute')").count() == 0


def test_all_measures_are_covered(spark, model):
    covered = [n for f in RELATIONSHIPS for n in (*sql_measures.bases(f), *sql_measures.ratios(f))]
    assert sorted(covered) == sorted(MEASURES)
    for name in ("mrr", "churn_rate_pct", "ecpm"):
        assert spark.sql(f"SELECT measure_value('{name}') AS v").first().v == pytest.approx(model.evaluate(name).first().value)
    assert spark.sql("SELECT measure_value('nothing') AS v").first().v is None


def test_ratios_of_nothing_are_zero(spark, model):
    row = spark.sql("SELECT churn_rate_pct(3, 4) AS a, churn_rate_pct(3, 0) AS b, ecpm(NULL, 5) AS c, ecpm(1, NULL) AS d").first()
    assert tuple(row) == (75.0, 0.0, 0.0, 0.0)


def test_only_the_dimension_asked_for_is_read(spark, model):
    plan = spark.sql("SELECT label, page_views FROM fct_engagement_measures('platform')")._jdf.queryExecution().optimizedPlan().toString()
    assert "dim_platform" in plan and plan.count("fct_engagement[") == 1
    assert not [d for d in ("dim_brand", "dim_content", "dim_date", "dim_subscriber") if d in plan]
