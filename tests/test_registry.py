"""Keys that stay from run to run."""

import pytest
from pyspark.sql import functions as F

from galley.operators.registry import KeyRegistry
from galley.plans import gold, pipeline
from galley.session import scratch_path
from galley.sources import catalog, seeds, synthetic

BRANDS = ("Alpha", "Bravo", "Cedar")
CALENDAR = pipeline.Calendar(gold.CALENDAR_START, gold.CALENDAR_END)


def place(spark, label):
    path = scratch_path(spark, label)
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


@pytest.fixture
def keys(spark):
    return KeyRegistry(spark, *place(spark, "keys"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string").withColumn("x", F.lit(1))


def held(df):
    return {r.id: r.key for r in df.collect()}


def test_new_ids_follow_the_largest_key(spark, keys):
    assert held(keys.register(ids(spark, "d", "b", "b"), "id", "k")) == {"b": 1, "d": 2}
    assert held(keys.register(ids(spark, "a", "c", "d"), "id", "k")) == {"b": 1, "d": 2, "a": 3, "c": 4}
    # nothing new, and ids that are gone
    assert held(keys.register(ids(spark, "c"), "id", "k")) == {"b": 1, "d": 2, "a": 3, "c": 4}
    assert held(keys.register(ids(spark).where("false"), "id", "k")) == {"b": 1, "d": 2, "a": 3, "c": 4}
    assert {r.id: r.batch for r in keys.known("k").collect()} == {"b": 1, "d": 1, "a": 2, "c": 2}


def test_a_null_id_has_one_key(spark, keys):
    keys.register(ids(spark, None, "a", None), "id", "k")
    got = held(keys.register(ids(spark, None, "b"), "id", "k"))
    assert got == {None: 1, "a": 2, "b": 3}
    assert sorted(r.k for r in keys.keyed(ids(spark, None, "b", "b"), "id", "k").collect()) == [1, 3, 3]


def test_large_growing_input_keeps_keys_unique(spark, keys):
    def table(low, high):
        return spark.range(low, high).select(F.xxhash64("id").cast("string").alias("id")).repartition(16)

    first = held(keys.register(table(0, 3000), "id", "k"))
    second = held(keys.register(table(1000, 9000), "id", "k"))
    assert sorted(first.values()) == list(range(1, 3001))
    assert sorted(second.values()) == list(range(1, 9001))
    assert all(second[i] == k for i, k in first.items())


def test_facts_of_two_runs_fit_together(spark):
    keys = KeyRegistry(spark, *place(spark, "keys"))
    raw = synthetic.raw_tables(spark, BRANDS, subscribers=800, events_per_day=(10, 20), ads_per_day=(5, 9))
    fewer = {
        **raw,
        "raw_subscriptions": raw["raw_subscriptions"].where("pmod(xxhash64(subscriber_id), 3) > 0"),
        "raw_content": raw["raw_content"].where("pmod(xxhash64(content_id), 3) > 0"),
    }
    found = []
    for tables in (fewer, raw):
        name, path = place(spark, "run")
        layers = catalog.Layers.for_stage(name, location=path)
        catalog.ensure_layers(spark, layers)
        pipeline.load_bronze(spark, layers, tables)
        pipeline.build_silver(spark, layers, keys=keys)
        pipeline.build_gold(
            spark, layers, CALENDAR, seeds.dim_brand(spark, BRANDS), seeds.dim_platform(spark), keys=keys
        )
        found.append({t: catalog.read_table(spark, layers.gold, t) for t in ("dim_subscriber", "dim_content", "dim_campaign")})
    for table, column in (("dim_subscriber", "subscriber"), ("dim_content", "content"), ("dim_campaign", "campaign")):
        old, new = ({r[0]: r[1] for r in f[table].select(f"{column}_id", f"{column}_key").collect()} for f in found)
        assert len(set(new.values())) == len(new) >= len(old)
        assert all(new[i] == k for i, k in old.items())
    assert found[0]["dim_subscriber"].count() < found[1]["dim_subscriber"].count()
    assert found[1]["dim_subscriber"].schema["subscriber_key"].dataType.simpleString() == "int"
