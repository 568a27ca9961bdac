"""The star schema of a folder, built once per session and kept as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from galley.plans import pipeline, rollups
from galley.plans.measures import StarModel
from galley.session import scratch_path
from galley.sources import retail
from galley.sources.catalog import Layers, ensure_layers, read_table


@dataclass(frozen=True)
class Star:
    layers: Layers
    bronze: dict[str, DataFrame]
    silver: dict[str, DataFrame]
    model: StarModel

    @property
    def gold(self) -> dict[str, DataFrame]:
        return dict(self.model.tables)


_built: dict[tuple[str, str], Star] = {}


def _plain(step: str, run: Callable[[], object]) -> object:
    return run()


def build_star(
    spark: SparkSession, folder: str, step: Callable[[str, Callable[[], object]], object] = _plain
) -> Star:
    """Write bronze, silver and gold tables of the folder to a fresh place.

    ``step(name, run)`` runs each layer; a caller may time it.
    """
    place = scratch_path(spark, "star")
    layers = Layers.for_stage(place.rsplit("/", 1)[-1].replace("-", "_"), location=place)
    ensure_layers(spark, layers)
    step("bronze", lambda: pipeline.load_bronze(spark, layers, retail.raw_tables(spark, folder)))
    step("silver", lambda: pipeline.build_silver(spark, layers, retail.KEY_TYPE))
    step(
        "gold",
        lambda: pipeline.build_gold(
            spark,
            layers,
            retail.CALENDAR,
            retail.brands(spark, folder),
            retail.platforms(spark),
            retail.KEY_TYPE,
        ),
    )
    return Star(
        layers,
        {t: read_table(spark, layers.bronze, t) for t in pipeline.BRONZE_TABLES},
        {t: read_table(spark, layers.silver, t) for t in pipeline.SILVER_TABLES},
        pipeline.load_model(spark, layers, retail.CALENDAR),
    )


def star(
    spark: SparkSession, folder: str, step: Callable[[str, Callable[[], object]], object] = _plain
) -> Star:
    """The tables of the folder; the first call of a session builds them.

    Queries over silver and gold read written tables, as a job downstream of the daily
    build would.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        _built[key] = build_star(spark, folder, step)
    return _built[key]


_stays: dict[tuple[str, str], DataFrame] = {}


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Stays of all subscribers over the whole calendar, written once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stays:
        _stays[key] = pipeline.load_stays(spark, star(spark, folder).layers, retail.CALENDAR, retail.DATA_END)
    return _stays[key]


_stored: dict[tuple[str, str], StarModel] = {}


def stored_model(spark: SparkSession, folder: str) -> StarModel:
    """The model with its roll-ups, which are written once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        built = star(spark, folder)
        rollups.build_rollups(spark, built.layers)
        _stored[key] = replace(built.model, rollups=rollups.load_rollups(spark, built.layers))
    return _stored[key]
