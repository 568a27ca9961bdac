"""Replacing what changed, versions of tables, and restarts of a stopped run."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from galley.operators.quality import QualityError
from galley.operators.registry import KeyRegistry
from galley.plans import gold, incremental, pipeline
from galley.plans.journal import Journal, row_fingerprint, table_fingerprint
from galley.session import scratch_path
from galley.sources import catalog, seeds, synthetic, versions

BRANDS = ("Alpha", "Bravo", "Cedar")
CALENDAR = pipeline.Calendar(gold.CALENDAR_START, gold.CALENDAR_END)


def named(spark, label):
    path = scratch_path(spark, label)
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


@pytest.fixture
def layer(spark):
    name, path = named(spark, "layer")
    catalog.ensure_layer(spark, name, path)
    return name


def files(spark, layer, name):
    table = spark.table(f"{layer}.{name}").select("date_month", F.col("_metadata.file_path").alias("path")).distinct()
    return {m: {r.path for r in table.collect() if r.date_month == m} for m in {r.date_month for r in table.collect()}}


# --- months -----------------------------------------------------------------------------

START = date(2026, 1, 1)


def source(spark, days=120):
    """Rows with days of four months, one day unknown, in no order."""
    day = F.date_add(F.lit(START), (F.col("id") * 7 % days).cast("int"))
    return spark.range(2000).select(
        F.when(F.col("id") % 100 != 0, day).alias("day"), (F.col("id") % 50).alias("v"), F.current_timestamp().alias("load_timestamp")
    )


def build(rows):
    return rows.select((F.datediff("day", F.lit(START)) + 1).alias("date_key"), "v")


def refresh(spark, layer, rows):
    return incremental.refresh_fact(spark, rows, "day", build, layer, "f", START)


def check(spark, layer, rows, expected):
    want = gold.with_month(build(expected), START).select("date_key", "v", "date_month")
    assert rows(spark.table(f"{layer}.f").select("date_key", "v", "date_month")) == rows(want)


def test_a_late_day_rewrites_its_month_only(spark, layer, rows):
    everything = source(spark)
    late = everything.where(F.col("day") == date(2026, 2, 10))
    early = everything.where(~F.coalesce(F.col("day") == date(2026, 2, 10), F.lit(False)))
    assert refresh(spark, layer, early) == [None, 202601, 202602, 202603, 202604]
    before = files(spark, layer, "f")
    assert late.count() > 0 and refresh(spark, layer, everything.repartition(3)) == [202602]
    after = files(spark, layer, "f")
    assert {m for m in before if before[m] != after[m]} == {202602}
    check(spark, layer, rows, everything)
    # the order of rows is no change, and neither is the time of the load
    assert refresh(spark, layer, everything.repartition(9)) == []
    assert files(spark, layer, "f") == after


def test_changed_repeated_and_lost_rows_are_seen(spark, layer, rows):
    first = source(spark)
    refresh(spark, layer, first)
    changed = first.withColumn("v", F.when(F.col("day") == date(2026, 3, 1), F.col("v") + 1).otherwise(F.col("v")))
    assert refresh(spark, layer, changed) == [202603]
    twice = changed.unionByName(changed.where(F.col("day") == date(2026, 4, 2)))
    assert refresh(spark, layer, twice) == [202604]
    unknown = twice.unionByName(twice.where("day IS NULL").limit(1))
    assert refresh(spark, layer, unknown) == [None]
    fewer = unknown.where("day IS NULL OR month(day) <> 1")  # a month that is gone
    assert refresh(spark, layer, fewer) == [202601]
    check(spark, layer, rows, fewer)


def test_partitions_without_new_rows_stay(spark, layer):
    refresh(spark, layer, source(spark))
    one = spark.createDataFrame([(60, 1, 202603)], "date_key int, v long, date_month int")
    catalog.replace_partitions(one, layer, "f", ["date_month"])
    assert spark.table(f"{layer}.f").where("date_month = 202603").count() == 1
    assert spark.table(f"{layer}.f").where("date_month = 202602").count() > 100


# --- versions ---------------------------------------------------------------------------


def numbers(spark, n, **columns):
    return spark.range(n).select("id", *[F.lit(v).alias(c) for c, v in columns.items()])


def test_publish_switches_after_the_check(spark, layer):
    first = versions.publish(numbers(spark, 10), layer, "t")
    assert first.count() == 10

    def refuse(rows):
        raise QualityError(f"{rows.count()} rows")

    with pytest.raises(QualityError, match="7 rows"):
        versions.publish(numbers(spark, 7), layer, "t", check=refuse)
    assert spark.table(f"{layer}.t").count() == 10 and len(versions.versions(spark, layer, "t")) == 1


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, layer):
    versions.publish(numbers(spark, 10), layer, "t", partition_by=[])
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(broken, layer, "t")
    assert spark.table(f"{layer}.t").count() == 10
    assert versions.publish(numbers(spark, 12), layer, "t").count() == 12  # and the next one succeeds


def test_versions_may_change_schema_and_read_what_they_replace(spark, layer):
    versions.publish(numbers(spark, 10, a=1), layer, "t", partition_by=["a"])
    versions.publish(spark.table(f"{layer}.t").where("id < 4").select("id"), layer, "t")
    assert spark.table(f"{layer}.t").columns == ["id"] and spark.table(f"{layer}.t").count() == 4
    back = versions.roll_back(spark, layer, "t")
    assert back.columns == ["id", "a"] and back.count() == 10
    with pytest.raises(ValueError, match="no earlier"):
        versions.roll_back(spark, layer, "t")
    versions.publish(numbers(spark, 3), layer, "t")
    versions.publish(numbers(spark, 2), layer, "t", keep=1)
    assert len(versions.versions(spark, layer, "t")) == 2 and versions.roll_back(spark, layer, "t").count() == 3


def test_a_plain_table_is_not_taken_over(spark, layer):
    catalog.write_table(numbers(spark, 3), layer, "t")
    with pytest.raises(ValueError, match="not published"):
        versions.publish(numbers(spark, 4), layer, "t")
    assert spark.table(f"{layer}.t").count() == 3


# --- restarts ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def raw(spark):
    """Raw tables as files, so that their fingerprints do not read rows."""
    name, path = named(spark, "raw")
    catalog.ensure_layer(spark, name, path)
    for table, df in synthetic.raw_tables(spark, BRANDS, subscribers=400, events_per_day=(10, 20), ads_per_day=(5, 9)).items():
        catalog.write_table(df, name, table)
    return {t: spark.table(f"{name}.{t}") for t in pipeline.BRONZE_TABLES}


def test_a_stopped_run_starts_again_where_it_stopped(spark, raw):
    name, path = named(spark, "run")
    layers = catalog.Layers.for_stage(name, location=path, versioned=True)
    journal = Journal(spark, *named(spark, "journal"))
    keys = KeyRegistry(spark, *named(spark, "keys"))

    def run(brands, tables=raw):
        return pipeline.run(
            spark, layers, tables, CALENDAR, seeds.dim_brand(spark, brands), seeds.dim_platform(spark), keys=keys, journal=journal
        )

    def done():
        return [r.step for r in journal.entries().orderBy("finished_at").collect()]

    with pytest.raises(QualityError, match="brand_key"):
        run(BRANDS[:1])
    assert done() == ["bronze", "silver"]
    counted = {r.table: r.rows for r in run(BRANDS).collect()}
    assert done() == ["bronze", "silver", "gold"] and counted["fct_subscription"] == 400
    run(BRANDS)
    assert done() == ["bronze", "silver", "gold"]  # nothing has changed

    fewer = {**raw, "raw_ad_impressions": raw["raw_ad_impressions"].where("impressions > 300")}
    ads = {r.table: r.rows for r in run(BRANDS, fewer).collect()}["silver_ad_impressions"]
    assert 0 < ads < counted["silver_ad_impressions"]
    assert done() == ["bronze", "silver", "gold"] * 2
    back = versions.roll_back(spark, layers.silver, "silver_ad_impressions")
    assert back.count() == counted["silver_ad_impressions"]


def test_a_lost_table_is_built_again(spark, layer):
    journal = Journal(spark, layer)
    done = []

    def build():
        catalog.write_table(numbers(spark, 3), layer, "made")
        done.append(1)

    def step(n=5, **of):
        return journal.step("s", build, [(layer, "made")], inputs={"x": numbers(spark, n)}, **of)

    assert step() and not step()
    spark.sql(f"DROP TABLE {layer}.made")
    assert step()
    assert step(settings="other") and not step(settings="other")
    assert step(6) and len(done) == 4


def test_fingerprints(spark, layer):
    assert row_fingerprint(numbers(spark, 5)) == row_fingerprint(numbers(spark, 5).repartition(3))
    assert row_fingerprint(numbers(spark, 5)) != row_fingerprint(numbers(spark, 6))
    assert row_fingerprint(numbers(spark, 0)) != row_fingerprint(numbers(spark, 1))
    catalog.write_table(numbers(spark, 5), layer, "t")
    held = table_fingerprint(spark, layer, "t")
    assert held == table_fingerprint(spark, layer, "t")
    catalog.write_table(numbers(spark, 5), layer, "t")
    assert table_fingerprint(spark, layer, "t") != held
