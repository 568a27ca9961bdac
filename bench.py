"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local threads. Every query
is written to the ``noop`` sink, so all rows and columns are produced; the better of two
runs counts. ``star_bronze``, ``star_silver`` and ``star_gold`` are the layers of the load and run
once, after a warm-up on the smallest tables; the queries after them read their tables. The ``media_*`` entries are the layers of the generated
media data at full size (about 650,000 raw rows), checks included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from entrypoints import star as stars  # noqa: E402
from entrypoints.queries import GENERATED_BRANDS, QUERIES  # noqa: E402
from galley.operators.quality import gate  # noqa: E402
from galley.plans import gold, pipeline  # noqa: E402
from galley.session import build_session, scratch_path  # noqa: E402
from galley.sources import seeds, synthetic  # noqa: E402
from galley.sources.catalog import Layers, ensure_layers  # noqa: E402

HEADLINE = (
    "sales_summary",
    "silver_engagement",
    "silver_ad_impressions",
    "surrogate_key",
    "dim_content",
    "dim_campaign",
    "fct_engagement",
    "fct_subscription",
    "fct_ad",
    "subscription_snapshot",
    "subscription_daily_totals",
    "n07_page_views_by_month",
    "n11_top_sections",
    "n12_mrr_trend",
    "n16_churn_by_brand_and_month",
    "n17_best_ecpm_brand",
    "n20_monthly_active_users",
    "n20_ad_revenue_by_campaign",
    "drill_across",
    "orphan_keys",
    "gen_ads",
    "reconcile",
    "dq_referential",
    "dq_suite",
)


def media_layers(spark, timed) -> dict[str, float]:
    place = scratch_path(spark, "media")
    layers = Layers.for_stage(place.rsplit("/", 1)[-1].replace("-", "_"), location=place)
    ensure_layers(spark, layers)
    calendar = pipeline.Calendar(gold.CALENDAR_START, gold.CALENDAR_END)
    raw = synthetic.raw_tables(spark, GENERATED_BRANDS)
    brands, platforms = seeds.dim_brand(spark, GENERATED_BRANDS), seeds.dim_platform(spark)
    seen: pipeline.Seen = {}
    return {
        "media_bronze": timed(lambda: pipeline.load_bronze(spark, layers, raw, seen)),
        "media_silver": timed(lambda: pipeline.build_silver(spark, layers, seen=seen)),
        "media_gold": timed(
            lambda: pipeline.build_gold(spark, layers, calendar, brands, platforms, seen=seen)
        ),
        "media_checks": timed(lambda: gate(pipeline.check_gold(spark, layers, calendar, seen=seen))),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(folder):
        stars.star(spark, small)  # warm-up: code is compiled and loaded before anything is timed
    times: dict[str, float] = {}

    def step(name, run):
        times[f"star_{name}"] = timed(run)

    stars.star(spark, folder, step)
    for name in HEADLINE:

        def run(name=name):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        times[name] = min(timed(run), timed(run))
    times.update(media_layers(spark, timed))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
