from datetime import date, datetime
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from galley import schemas
from galley.plans import reports, warehouse
from galley.session import scratch_path, scratch_root
from galley.sources import catalog, files, seeds, synthetic


@pytest.fixture
def layer(spark):
    place = scratch_path(spark, "layer")
    name = place.rsplit("/", 1)[-1].replace("-", "_")
    catalog.ensure_layer(spark, name, place)
    catalog.ensure_layer(spark, name, place)
    return name


def _session(master, shared):
    """A stand-in: the setting of a running session cannot be changed."""
    return SimpleNamespace(
        conf=SimpleNamespace(
            get=lambda key, *default: shared if key == "spark.checkpoint.dir" else "hdfs://warehouse"
        ),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_scratch_follows_the_session_setting():
    cluster = _session("spark://host:7077", "hdfs://shared/")
    assert scratch_root(cluster) == "hdfs://shared"
    assert scratch_path(cluster, "a") != scratch_path(cluster, "a")


def test_scratch_is_never_machine_local_on_a_cluster():
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "local[2]"):
        assert scratch_root(_session(master, None)) == f"hdfs://warehouse/scratch-app-{master}"


def test_table_round_trip_and_schema_replacement(spark, layer, rows):
    catalog.write_table(spark.range(5), layer, "t", cluster_by=["id"])
    assert catalog.read_table(spark, layer, "t").count() == 5
    catalog.write_table(spark.createDataFrame([("x",)], "name string"), layer, "t", overwrite_schema=True)
    assert rows(catalog.read_table(spark, layer, "t")) == [("x",)]


def test_default_format(spark, layer, rows):
    audience = warehouse.load_example_audience(spark, layer, ["Alpha", "Bravo", "Cedar", "Delta"])
    assert ("Bravo", "mobile", 1310, 180) in rows(audience)


def test_probes(spark, layer):
    catalog.write_table(spark.range(1), layer, "t")
    assert catalog.exists(spark, layer) and catalog.exists(spark, layer, "t", "id")
    assert not catalog.exists(spark, "no_such_layer")
    assert not catalog.exists(spark, layer, "u")
    assert not catalog.exists(spark, layer, "t", "name")


def test_describe_preview_and_first(spark, layer):
    catalog.write_table(spark.range(9), layer, "t")
    table = catalog.read_table(spark, layer, "t")
    assert tuple(catalog.describe_columns(spark, layer, "t").first()) == ("id", "bigint")
    assert catalog.describe(spark, layer, "t").where("col_name = 'Provider'").count() == 1
    assert [r.id for r in catalog.preview(table, 3, ["id"]).collect()] == [0, 1, 2]
    assert catalog.first_value(table.agg(F.max("id"))) == 8
    assert catalog.first_value(table.where("id > 100")) is None


def test_layer_counts(spark, layer, rows):
    catalog.write_table(spark.range(3), layer, "a")
    catalog.write_table(spark.range(0), layer, "b")
    assert rows(catalog.layer_counts(spark, layer, ["a", "b"])) == [("a", 3), ("b", 0)]


def test_views(spark, layer, rows):
    view = catalog.create_view(spark.range(2), "two_rows")
    assert view.count() == 2 and spark.sql("SELECT * FROM two_rows").count() == 2
    catalog.write_table(spark.range(4), layer, "t")
    for least in (1, 3):
        stored = catalog.create_layer_view(spark, layer, "v", f"SELECT * FROM {layer}.t WHERE id >= {least}")
    assert rows(stored) == [(3,)]


def test_stages_share_code_not_tables():
    dev, uat = catalog.Layers.for_stage("dev"), catalog.Layers.for_stage("uat")
    assert dev.names() == ("dev_bronze", "dev_silver", "dev_gold")
    assert not set(dev.names()) & set(uat.names())


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [("a,b", 'say "x"', date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5, 678901), 1.25, None)],
        "t string, q string, d date, ts timestamp, v double, n int",
    )
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)


def test_sales_warehouse(spark, layer, rows):
    warehouse.create_warehouse(spark, layer)
    catalog.seed(spark, layer, "customer", seeds.SALES_CUSTOMER_ROWS, schemas.SALES_CUSTOMER)
    catalog.seed(
        spark, layer, "customer", [(4, "Quiet Ltd", None, "Europe", None)], schemas.SALES_CUSTOMER
    )
    catalog.seed(spark, layer, "order", seeds.SALES_ORDER_ROWS, schemas.SALES_ORDER)
    # creating again must not lose the rows
    warehouse.create_warehouse(spark, layer)
    customers = catalog.read_table(spark, layer, "customer")
    orders = catalog.read_table(spark, layer, "order")
    assert rows(warehouse.sales_summary(customers, orders)) == [
        (1, "Acme Corp", "North America", 2, Decimal("23500.00"), date(2026, 6, 15)),
        (2, "Global Media Inc", "Europe", 1, Decimal("22000.00"), date(2026, 6, 10)),
        (3, "TechStart LLC", "Asia Pacific", 1, Decimal("5000.00"), date(2026, 6, 20)),
        (4, "Quiet Ltd", "Europe", 0, None, None),
    ]
    checks = warehouse.check_warehouse(spark, layer).collect()
    assert all(r.passed for r in checks) and len(checks) == 10

    catalog.seed(
        spark, layer, "order", [(104, 9, date(2026, 6, 1), Decimal("-1.00"), "x")], schemas.SALES_ORDER
    )
    failed = {
        (r.check, r.violations)
        for r in warehouse.warehouse_checks(customers, catalog.read_table(spark, layer, "order")).collect()
        if not r.passed
    }
    assert failed == {("unique", 1), ("fk_exists", 1), ("non_negative", 1)}


def test_config_store(spark, layer):
    warehouse.create_config_store(spark, layer)
    now = datetime(2026, 1, 1)
    catalog.seed(spark, layer, "config", seeds.config_rows("UAT", "example.com", now), schemas.APP_CONFIG)
    config = catalog.read_table(spark, layer, "config")
    found = {k: catalog.config_value(config, k).first() for k in ("log_level", "api_endpoint", "none")}
    assert found["log_level"][0] == "INFO"
    assert found["api_endpoint"][0] == "https://uat-api.example.com"
    assert found["none"] is None
    assert all(r.passed for r in warehouse.check_config_store(spark, layer).collect())


def test_missing_tables_are_reported(spark, layer):
    catalog.ensure_table(spark, layer, "customer", schemas.SALES_CUSTOMER)
    failed = warehouse.check_warehouse(spark, layer).where("NOT passed").collect()
    assert [r.target for r in failed] == [f"{layer}.order"]
    assert not warehouse.check_config_store(spark, layer).first().passed
    assert not warehouse.check_config_store(spark, "no_such_layer").first().passed


def test_sample_events(spark, layer):
    events = warehouse.load_sample_events(spark, layer)
    top = reports.top_event_types(events)
    assert [tuple(r) for r in top.collect()] == [("page_view", 2), ("click", 1), ("exit", 1)]
    assert all(r.passed for r in warehouse.event_checks(events).collect())
    faulty = events.drop("user_id").withColumn("event_id", F.lit(None).cast("int"))
    failed = {(r.check, r.violations) for r in warehouse.event_checks(faulty).where("NOT passed").collect()}
    assert failed == {("has_columns", 1), ("no_nulls", 5)}


BRANDS = ("Alpha", "Bravo", "Cedar", "Delta", "Ember")


@pytest.fixture(scope="module")
def raw(spark):
    return synthetic.raw_tables(
        spark, BRANDS, days=30, subscribers=2000, events_per_day=(50, 70), ads_per_day=(10, 15)
    )


def test_generated_schemas(raw):
    expected = {
        "raw_content": schemas.RAW_CONTENT,
        "raw_subscriptions": schemas.RAW_SUBSCRIPTIONS,
        "raw_engagement": schemas.RAW_ENGAGEMENT,
        "raw_ad_impressions": schemas.RAW_AD_IMPRESSIONS,
    }
    for name, schema in expected.items():
        assert [(f.name, f.dataType) for f in raw[name].schema] == [(f.name, f.dataType) for f in schema]


def test_generated_content(raw):
    content = raw["raw_content"]
    per_brand = {r.brand: r["count"] for r in content.groupBy("brand").count().collect()}
    assert per_brand == {b: 400 for b in BRANDS}
    assert content.select("content_id").distinct().count() == 2000
    first = content.orderBy("content_id").first()
    assert first.content_id == "CNT000001"
    assert first.title == f"Alpha {first.section} {first.content_type} #1"


def test_generated_subscriptions(raw):
    s = raw["raw_subscriptions"]
    assert s.where("churn_date IS NOT NULL AND (is_active OR churn_date > DATE '2026-06-23')").count() == 0
    assert s.where("NOT is_active AND churn_date IS NULL").count() == 0
    share = s.where("NOT is_active").count() / s.count()
    assert 0.05 < share < 0.13
    assert {r.mrr for r in s.select("mrr").distinct().collect()} == {9.99, 14.99, 19.99}


def test_generated_events(raw):
    e = raw["raw_engagement"]
    n = e.count()
    assert 30 * 50 <= n <= 30 * 70
    # the ids are unique however many partitions made them
    assert e.select("event_id").distinct().count() == n
    assert e.repartition(16).select("event_id").distinct().count() == n
    assert e.where("page_views NOT BETWEEN 1 AND 12").count() == 0
    assert e.where("time_on_page_sec NOT BETWEEN page_views * 30 AND page_views * 300").count() == 0
    known = e.where("subscriber_id IS NOT NULL").count() / n
    assert 0.5 < known < 0.7


def test_generated_ads(raw):
    a = raw["raw_ad_impressions"]
    assert a.where("clicks > impressions * 0.03 OR clicks < floor(impressions * 0.005)").count() == 0
    assert a.where("ad_revenue > clicks * 2.5 + 0.01 OR ad_revenue < clicks * 0.25 - 0.01").count() == 0
    names = a.select("campaign_name").distinct().collect()
    assert all(r[0].endswith(" Campaign") for r in names)


def test_generated_rows_do_not_depend_on_chunks(spark, rows):
    days = synthetic.data_days(spark, date(2026, 3, 25), 5, (30, 40))
    one = synthetic.daily_rows(days, rows_per_chunk=1000)
    many = synthetic.daily_rows(days.repartition(4), rows_per_chunk=7)
    assert rows(one, "id", "day") == rows(many, "id", "day")
    assert [r.id for r in one.orderBy("id").collect()] == list(range(one.count()))


def test_parquet_tables_are_compressed_with_zstd(spark, tmp_path):
    """Also those whose partitions are replaced later, as the option stays with the table."""
    layer = "zstd_layer"
    catalog.ensure_layer(spark, layer, str(tmp_path))
    rows = spark.range(1000).select((F.col("id") % 2).alias("part"), "id")
    catalog.write_table(rows, layer, "t", partition_by=["part"])
    catalog.replace_partitions(rows.where("part = 1"), layer, "t", ["part"])
    files = list(tmp_path.rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)
