"""The whole run: raw tables -> silver -> gold, with checks after each layer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import quality as q
from galley.operators.registry import KeyRegistry
from galley.plans import gold, silver
from galley.plans.measures import (
    RECONCILE_SQL,
    RELATIONSHIPS,
    StarModel,
    expected_values,
    measured_values,
)
from galley.plans.journal import Journal
from galley.sources.catalog import Layers, ensure_layers, layer_counts, read_table, write_table
from galley.sources.versions import publish

BRONZE_TABLES = ("raw_content", "raw_subscriptions", "raw_engagement", "raw_ad_impressions")
SILVER_TABLES = (
    "silver_content",
    "silver_subscriptions",
    "silver_engagement",
    "silver_ad_impressions",
)
DIMENSIONS = {
    "dim_date": "date_key",
    "dim_brand": "brand_key",
    "dim_content": "content_key",
    "dim_subscriber": "subscriber_key",
    "dim_platform": "platform_key",
    "dim_campaign": "campaign_key",
}
FACTS = tuple(RELATIONSHIPS)
GOLD_TABLES = (*DIMENSIONS, *FACTS)

# The daily snapshot is a fact beside the star: a row per subscriber and day, written on request.
SNAPSHOT = "fct_subscription_daily"
STAYS = "fct_subscription_stays"
SNAPSHOT_LINKS = {
    SNAPSHOT: {"dim_date": "date_key", "dim_brand": "brand_key", "dim_subscriber": "subscriber_key"}
}

# Anonymous traffic has no subscriber, so this key may be null.
NULLABLE_KEYS = {("fct_engagement", "subscriber_key")}

MEASURE_COLUMNS = {
    "fct_engagement": ("page_views", "sessions"),
    "fct_subscription": ("mrr",),
    "fct_ad": ("impressions", "clicks", "ad_revenue"),
}


@dataclass(frozen=True)
class Calendar:
    start: date
    end: date


# --- layers -----------------------------------------------------------------------------


def side_by_side(writes: Sequence[Callable[[], object]]) -> list:
    """Start independent writes together, so that the tail of one (few tasks left) does
    not leave executors idle. An error of any is raised once all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        return list(pool.map(lambda write: write(), writes))


# Tables by name with what their writes have observed. A build fills it where one is given.
Seen = dict[str, q.Observed]


def _watched(seen: Seen | None, table: str, rules: Sequence[q.Rule], figures: Mapping | None = None):
    """What a write of the table is to be watched by; None where nobody looks."""
    if seen is None:
        return None
    seen[table] = q.Observed(table, rules, figures)
    return seen[table].watch


def _put(layers: Layers, df: DataFrame, layer: str, name: str, **layout) -> None:
    """Replaces a table of the run, by a new version where the layers have versions."""
    write = publish if layers.versioned else write_table
    write(df, layer, name, fmt=layers.fmt, **layout)


def load_bronze(
    spark: SparkSession, layers: Layers, raw: Mapping[str, DataFrame], seen: Seen | None = None
) -> None:
    side_by_side(
        [
            lambda t=t: _put(
                layers, raw[t], layers.bronze, t, watch=_watched(seen, t, bronze_rules(t))
            )
            for t in BRONZE_TABLES
        ]
    )


def build_silver(
    spark: SparkSession,
    layers: Layers,
    key_type: str = "int",
    seen: Seen | None = None,
    keys: KeyRegistry | None = None,
) -> None:
    builders = {
        "silver_content": lambda raw: silver.silver_content(raw, key_type, keys),
        "silver_subscriptions": lambda raw: silver.silver_subscriptions(raw, key_type, keys),
        "silver_engagement": silver.silver_engagement,
        "silver_ad_impressions": silver.silver_ad_impressions,
    }

    def put(name: str) -> None:
        source = name.replace("silver_", "raw_")
        rows = builders[name](read_table(spark, layers.bronze, source))
        watch = _watched(seen, name, silver_rules(name))
        _put(layers, rows, layers.silver, name, watch=watch)

    side_by_side([lambda t=t: put(t) for t in SILVER_TABLES])


def build_gold(
    spark: SparkSession,
    layers: Layers,
    calendar: Calendar,
    brands: DataFrame,
    platforms: DataFrame,
    key_type: str = "int",
    seen: Seen | None = None,
    keys: KeyRegistry | None = None,
) -> None:
    """Dimensions are written and read back before the facts use them: their size is then
    known to the optimizer, which broadcasts only those that are small. Facts are
    partitioned by month and sorted by day."""
    s = {name: read_table(spark, layers.silver, name) for name in SILVER_TABLES}

    def put(df: DataFrame, name: str, **layout) -> DataFrame:
        figures = {title: F.expr(text) for title, text in RECONCILE_SQL.get(name, {}).items() if _adds_up(text)}
        watch = _watched(seen, name, gold_rules(name), figures)
        _put(layers, df, layers.gold, name, overwrite_schema=True, watch=watch, **layout)
        return read_table(spark, layers.gold, name)

    dates, brand, platform, campaigns = side_by_side(
        [
            lambda: put(gold.dim_date(spark, calendar.start, calendar.end), "dim_date"),
            lambda: put(brands, "dim_brand"),
            lambda: put(platforms, "dim_platform"),
            lambda: put(gold.dim_campaign(s["silver_ad_impressions"], key_type, keys), "dim_campaign"),
        ]
    )
    content, subscribers = side_by_side(
        [
            lambda: put(gold.dim_content(s["silver_content"], brand), "dim_content"),
            lambda: put(gold.dim_subscriber(s["silver_subscriptions"], dates), "dim_subscriber"),
        ]
    )
    facts = {
        "fct_engagement": gold.fct_engagement(
            s["silver_engagement"], dates, brand, content, subscribers, platform
        ),
        "fct_subscription": gold.fct_subscription(s["silver_subscriptions"], dates, brand),
        "fct_ad": gold.fct_ad(s["silver_ad_impressions"], dates, brand, campaigns, platform),
    }
    layout = {"partition_by": ["date_month"], "cluster_by": ["date_key"]}
    side_by_side(
        [lambda f=f: put(gold.with_month(facts[f], calendar.start), f, **layout) for f in FACTS]
    )


def load_snapshot(spark: SparkSession, layers: Layers, calendar: Calendar, data_end: date) -> DataFrame:
    """Writes the daily snapshot as a gold fact, partitioned by month and sorted by day."""
    rows = gold.subscription_snapshot(
        read_table(spark, layers.silver, "silver_subscriptions"),
        read_table(spark, layers.gold, "dim_brand"),
        calendar.start,
        data_end,
    )
    write_table(
        gold.with_month(rows, calendar.start),
        layers.gold,
        SNAPSHOT,
        layers.fmt,
        overwrite_schema=True,
        partition_by=["date_month"],
        cluster_by=["date_key"],
    )
    return read_table(spark, layers.gold, SNAPSHOT)


def load_stays(spark: SparkSession, layers: Layers, calendar: Calendar, data_end: date) -> DataFrame:
    """Writes the stays of all subscribers as a gold fact."""
    rows = gold.subscription_stays(
        read_table(spark, layers.silver, "silver_subscriptions"),
        read_table(spark, layers.gold, "dim_brand"),
        calendar.start,
        data_end,
    )
    write_table(rows, layers.gold, STAYS, layers.fmt, overwrite_schema=True, cluster_by=["from_key"])
    return read_table(spark, layers.gold, STAYS)


def load_model(spark: SparkSession, layers: Layers, calendar: Calendar) -> StarModel:
    tables = {name: read_table(spark, layers.gold, name) for name in GOLD_TABLES}
    return StarModel(tables, calendar.start)


# --- checks -----------------------------------------------------------------------------


IDS = {"content": "content_id", "subscriptions": "subscriber_id", "engagement": "event_id",
       "ad_impressions": "impression_id"}


def _id_of(table: str) -> str:
    return IDS[table.split("_", 1)[1]]


def bronze_rules(table: str) -> list[q.Rule]:
    return [q.rule_not_empty(), q.rule_no_null(_id_of(table))]


def silver_rules(table: str) -> list[q.Rule]:
    rules = [q.rule_not_empty()]
    if table == "silver_subscriptions":
        rules.append(q.rule_no_null("signup_date"))
        rules.append(q.rule_expect("churn_after_signup", F.col("churn_date") >= F.col("signup_date")))
    return rules


def bronze_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    return q.run_suite([q.table_checks(tables[t], t, bronze_rules(t)) for t in BRONZE_TABLES])


def _silver_unique(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [q.unique(tables[t], t, [_id_of(t)]) for t in SILVER_TABLES]


def silver_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    scans = [q.table_checks(tables[t], t, silver_rules(t)) for t in SILVER_TABLES]
    return q.run_suite([*scans, *_silver_unique(tables)])


def gold_rules(table: str) -> list[q.Rule]:
    """Everything about one gold table that a single scan can answer."""
    rules = [q.rule_not_empty()]
    if table in DIMENSIONS:
        rules.append(q.rule_no_null(DIMENSIONS[table]))
        if table == "dim_date":
            rules.append(q.rule_no_gaps("full_date"))
        return rules
    for key in RELATIONSHIPS[table].values():
        if (table, key) not in NULLABLE_KEYS:
            rules.append(q.rule_no_null(key))
    rules += [q.rule_non_negative(c) for c in MEASURE_COLUMNS[table]]
    if table == "fct_ad":
        rules.append(q.rule_expect("clicks<=impressions", F.col("clicks") <= F.col("impressions")))
    return rules


def gold_checks(tables: Mapping[str, DataFrame], seen: Seen | None = None) -> DataFrame:
    """Existence, keys, integrity, continuity and business rules of the star schema.

    What the writes have ``seen`` is not looked up again: keys and links remain to be read.
    """
    if seen is None:
        rules = [q.table_checks(tables[t], t, gold_rules(t)) for t in GOLD_TABLES]
    else:
        rules = [seen[t].checks(tables[t].sparkSession, tables[t]) for t in GOLD_TABLES]
    keys = q.unique_keys(tables, DIMENSIONS)
    links = q.star_links_exist(tables, RELATIONSHIPS)
    return q.run_suite([*rules, keys, links])


SOURCES = {
    "fct_engagement": "silver_engagement",
    "fct_subscription": "silver_subscriptions",
    "fct_ad": "silver_ad_impressions",
}


def row_count_checks(silver_tables: Mapping[str, DataFrame], facts: Mapping[str, DataFrame]) -> DataFrame:
    """Lookups must neither lose nor multiply fact rows."""
    return q.run_suite(
        [q.same_count(silver_tables[s], facts[f], f"{s}->{f}") for f, s in SOURCES.items()]
    )


def contract_checks(tables: Mapping[str, DataFrame], key_type: str = "int") -> DataFrame:
    return q.run_suite([q.contract(tables[t], t, key_type) for t in GOLD_TABLES])


def reconciliation(model: StarModel, tolerance: float = 0.01) -> DataFrame:
    return q.reconcile(measured_values(model), expected_values(model.tables), tolerance)


def _adds_up(text: str) -> bool:
    """Whether a figure can be observed; distinct counts cannot."""
    return "DISTINCT" not in text


def observed_reconciliation(model: StarModel, seen: Seen, tolerance: float = 0.01) -> DataFrame:
    """Measures of the stored tables against the figures that their writes have observed.

    Distinct counts are stated in SQL over the table, as in ``reconciliation``.
    """
    spark = model.tables["dim_date"].sparkSession
    figures = {title: value for f in FACTS for title, value in seen[f].figures.items()}
    rows = [(title, None if value is None else float(value)) for title, value in figures.items()]
    others = {
        fact: {title: text for title, text in texts.items() if not _adds_up(text)}
        for fact, texts in RECONCILE_SQL.items()
    }
    counted = expected_values(model.tables, {f: texts for f, texts in others.items() if texts})
    expected = spark.createDataFrame(rows, "measure string, value double").unionByName(counted)
    return q.reconcile(measured_values(model), expected, tolerance)


def check_gold(
    spark: SparkSession,
    layers: Layers,
    calendar: Calendar,
    key_type: str = "int",
    seen: Seen | None = None,
) -> DataFrame:
    """All checks of an existing gold layer; if tables are missing, only that is reported.

    With what the writes of this run have ``seen``, facts are read for links and measures only.
    """
    present = q.tables_exist(spark, layers.gold, GOLD_TABLES)
    if q.summarise(present).first().failed:
        return present
    model = load_model(spark, layers, calendar)
    return q.run_suite(
        [
            present,
            gold_checks(model.tables, seen),
            contract_checks(model.tables, key_type),
            q.reconciliation_checks(
                reconciliation(model) if seen is None else observed_reconciliation(model, seen)
            ),
        ]
    )


def snapshot_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Keys, links, flags and amounts of the daily snapshot; its grain is subscriber and day."""
    rows = tables[SNAPSHOT]
    keys = SNAPSHOT_LINKS[SNAPSHOT].values()
    one_state = F.col("active_flag") + F.col("churned_flag") == 1
    rules = [q.rule_not_empty(), *[q.rule_no_null(k) for k in keys], q.rule_non_negative("mrr")]
    return q.run_suite(
        [
            q.table_checks(rows, SNAPSHOT, [*rules, q.rule_expect("active_or_churned", one_state)]),
            q.star_links_exist(tables, SNAPSHOT_LINKS),
            q.unique(rows, SNAPSHOT, ["date_key", "subscriber_key"]),
        ]
    )


# --- run --------------------------------------------------------------------------------


def run(
    spark: SparkSession,
    layers: Layers,
    raw: Mapping[str, DataFrame],
    calendar: Calendar,
    brands: DataFrame,
    platforms: DataFrame,
    key_type: str = "int",
    keys: KeyRegistry | None = None,
    journal: Journal | None = None,
    accept: Mapping[str, str] | None = None,
) -> DataFrame:
    """Build all layers; stop with ``QualityError`` at the first layer whose checks fail.

    With a registry of ``keys``, surrogate keys are those of earlier runs where ids are known.
    With a ``journal``, a layer that was built and checked before from the same input is not built
    again: a run that was stopped starts at the layer that stopped it. ``accept`` names targets
    whose faults are known, with the reason.
    Rules on rows and row counts are observed by the writes. Returns (layer, table, rows) of
    everything written.
    """
    ensure_layers(spark, layers)
    seen: Seen = {}

    def bronze_layer() -> None:
        load_bronze(spark, layers, raw, seen)
        q.gate(q.run_suite([seen[t].checks(spark) for t in BRONZE_TABLES]), accept)

    def silver_layer() -> None:
        build_silver(spark, layers, key_type, seen, keys)
        stored = tables_of(layers.silver, SILVER_TABLES)
        q.gate(q.run_suite([*(seen[t].checks(spark) for t in SILVER_TABLES), *_silver_unique(stored)]), accept)

    def gold_layer() -> None:
        build_gold(spark, layers, calendar, brands, platforms, key_type, seen, keys)
        if set(SOURCES.values()) <= set(seen):
            same = [q.same_rows(seen[s], seen[f], f"{s}->{f}") for f, s in SOURCES.items()]
        else:  # silver was built by an earlier run
            same = [row_count_checks(tables_of(layers.silver, SILVER_TABLES), tables_of(layers.gold, FACTS))]
        q.gate(q.run_suite([*same, check_gold(spark, layers, calendar, key_type, seen)]), accept)

    def tables_of(layer: str, names: Sequence[str]) -> dict[str, DataFrame]:
        return {t: read_table(spark, layer, t) for t in names}

    def step(name: str, build: Callable[[], None], made: Sequence[str], **of) -> None:
        if journal is None:
            build()
        else:
            journal.step(name, build, [(getattr(layers, name), t) for t in made], **of)

    step("bronze", bronze_layer, BRONZE_TABLES, inputs=raw)
    read = [(layers.bronze, t) for t in BRONZE_TABLES]
    step("silver", silver_layer, SILVER_TABLES, tables=read, settings=key_type)
    read = [(layers.silver, t) for t in SILVER_TABLES]
    settings = f"{key_type} {calendar.start} {calendar.end}"
    small = {"brands": brands, "platforms": platforms}
    step("gold", gold_layer, GOLD_TABLES, inputs=small, tables=read, settings=settings)
    return counts(spark, layers)


def counts(spark: SparkSession, layers: Layers) -> DataFrame:
    per_layer = (
        (layers.bronze, BRONZE_TABLES),
        (layers.silver, SILVER_TABLES),
        (layers.gold, GOLD_TABLES),
    )
    frames = [
        layer_counts(spark, layer, tables).select(F.lit(layer).alias("layer"), "table", "rows")
        for layer, tables in per_layer
    ]
    return q.run_suite(frames)
