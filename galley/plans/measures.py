"""Named measures over the star schema, evaluated under any slice.

``StarModel.query(measures, by, where, period, order_by, limit)`` is one aggregation per
fact table involved, joined on the grouping columns if there are several facts.

* A dimension filter becomes a semi-join on the key, so it removes fact rows before any
  other work; a date period becomes a range on ``date_key``, which reaches the file scan,
  and on ``date_month`` where the fact is partitioned by it, which skips whole folders.
* Sums and counts are grouped by the foreign keys first and joined to the dimensions
  afterwards: the join sees one row per key combination, not one per fact row.
* Distinct counts cannot be added up: the rows are first reduced to the distinct combinations of
  foreign keys and counted value, then joined and counted by the final attributes. Ratios are
  computed last, from their aggregated parts.
* With stored roll-ups (``rollups``), what they cover is answered from them, distinct counts
  included, and the fact is not read.
* Grouping uses left joins: facts without a dimension row stay, under null, and the groups
  of an additive measure add up to its total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.columns import DISPLAY, safe_ratio
from galley.operators.lookup import drill_across
from galley.plans.gold import date_key_of

# --- registry ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Base:
    """An aggregate of one fact table: 'sum' of a column, 'rows' with a flag set, or the
    'distinct' values of a column (among rows with a flag set, if one is named)."""

    fact: str
    kind: str
    column: str
    flag: str | None = None

    def row_value(self) -> Column:
        """What one fact row contributes."""
        if self.kind == "sum":
            return F.col(self.column)
        if self.kind == "rows":
            return F.when(F.col(self.column) == 1, F.lit(1)).otherwise(F.lit(0))
        if self.flag:
            return F.when(F.col(self.flag) == 1, F.col(self.column))
        return F.col(self.column)

    def aggregate(self) -> Column:
        if self.kind == "distinct":
            return F.count_distinct(self.row_value())
        return F.sum(self.row_value())

    def columns(self) -> list[str]:
        return [self.column] + ([self.flag] if self.flag else [])


@dataclass(frozen=True)
class Measure:
    """A base aggregate, or a ratio of two others (times ``scale``, 0 on division by 0)."""

    name: str
    title: str
    display: str
    base: Base | None = None
    ratio: tuple[str, str] | None = None
    scale: int = 1


def _base(name: str, title: str, display: str, *base: str) -> Measure:
    return Measure(name, title, display, base=Base(*base))


def _ratio(name: str, title: str, display: str, parts: tuple[str, str], scale: int = 1) -> Measure:
    return Measure(name, title, display, ratio=parts, scale=scale)


COUNT, DECIMAL, MONEY, CENTS, PERCENT = "#,##0", "#,##0.00", "$#,##0", "$#,##0.00", "0.00%"

MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        # engagement
        _base("page_views", "Page Views", COUNT, "fct_engagement", "sum", "page_views"),
        _base("sessions", "Sessions", COUNT, "fct_engagement", "sum", "sessions"),
        _base("time_on_page_sec", "Time on Page (sec)", COUNT, "fct_engagement", "sum", "time_on_page_sec"),
        _ratio("avg_time_on_page_sec", "Avg Time on Page (sec)", DECIMAL, ("time_on_page_sec", "sessions")),
        _base("active_users", "Active Users", COUNT, "fct_engagement", "distinct", "subscriber_key"),
        # subscription
        _base("active_subscribers", "Active Subscribers", COUNT, "fct_subscription", "distinct", "subscriber_key", "active_flag"),
        _base("new_subscribers", "New Subscribers", COUNT, "fct_subscription", "rows", "new_flag"),
        _base("churned_subscribers", "Churned Subscribers", COUNT, "fct_subscription", "rows", "churned_flag"),
        _ratio("churn_rate_pct", "Churn Rate %", PERCENT, ("churned_subscribers", "active_subscribers"), 100),
        _base("mrr", "MRR", MONEY, "fct_subscription", "sum", "mrr"),
        _ratio("arpu", "ARPU", CENTS, ("mrr", "active_subscribers")),
        _ratio("new_subscriber_growth_pct", "New Subscriber Growth %", PERCENT, ("new_subscribers", "active_subscribers"), 100),
        # advertising
        _base("ad_revenue", "Ad Revenue", MONEY, "fct_ad", "sum", "ad_revenue"),
        _base("ad_impressions", "Ad Impressions", COUNT, "fct_ad", "sum", "impressions"),
        _base("ad_clicks", "Ad Clicks", COUNT, "fct_ad", "sum", "clicks"),
        _ratio("ctr_pct", "CTR %", PERCENT, ("ad_clicks", "ad_impressions"), 100),
        _ratio("ecpm", "eCPM", CENTS, ("ad_revenue", "ad_impressions"), 1000),
    )
}

_BY_TITLE = {m.title: m for m in MEASURES.values()}

# fact -> dimension -> key. The key has the same name on both sides.
RELATIONSHIPS: dict[str, dict[str, str]] = {
    "fct_engagement": {
        "dim_date": "date_key",
        "dim_brand": "brand_key",
        "dim_content": "content_key",
        "dim_subscriber": "subscriber_key",
        "dim_platform": "platform_key",
    },
    "fct_subscription": {
        "dim_date": "date_key",
        "dim_brand": "brand_key",
        "dim_subscriber": "subscriber_key",
    },
    "fct_ad": {
        "dim_date": "date_key",
        "dim_brand": "brand_key",
        "dim_campaign": "campaign_key",
        "dim_platform": "platform_key",
    },
}

# How a report adds up a fact column placed on it without a measure.
SUMMARIZE_BY: dict[str, dict[str, str]] = {
    fact: {
        **{key: "none" for key in keys.values()},
        **{c: "sum" for c in sums},
        **{c: "none" for c in flags},
    }
    for (fact, keys), sums, flags in zip(
        RELATIONSHIPS.items(),
        (
            ("page_views", "sessions", "time_on_page_sec"),
            ("mrr",),
            ("impressions", "clicks", "ad_revenue"),
        ),
        ((), ("active_flag", "new_flag", "churned_flag"), ()),
        strict=True,
    )
}


def measure(name: str) -> Measure:
    """By short name or by title."""
    found = MEASURES.get(name) or _BY_TITLE.get(name)
    if found is None:
        raise KeyError(f"unknown measure: {name}")
    return found


def _bases_of(m: Measure) -> list[str]:
    if m.base:
        return [m.name]
    return [b for part in m.ratio for b in _bases_of(MEASURES[part])]


def _finished(m: Measure) -> Column:
    """Value of a measure over columns that hold its aggregated bases."""
    if m.base:
        return F.col(f"__{m.name}")
    top, bottom = (_finished(MEASURES[p]) for p in m.ratio)
    return safe_ratio(top, bottom, m.scale)


# --- evaluation -------------------------------------------------------------------------


@dataclass(frozen=True)
class StarModel:
    """Dimension and fact tables by name, the day that has ``date_key`` 1, and stored roll-ups
    (``galley.plans.rollups.Rollups``), if there are any."""

    tables: Mapping[str, DataFrame]
    calendar_start: date
    rollups: Any = None

    def relate(self, fact: str, dim: str) -> DataFrame:
        """Fact rows with the attributes of one dimension."""
        key = self._key(fact, dim)
        return self.tables[fact].join(self.tables[dim], key, "left")

    def _key(self, fact: str, dim: str) -> str:
        try:
            return RELATIONSHIPS[fact][dim]
        except KeyError:
            raise ValueError(f"{dim} does not filter {fact}") from None

    def last_day(self, fact: str) -> date:
        """The latest day with facts.

        Facts are partitioned by month: the last month is found without reading a column, and
        days are read from its files only.
        """
        rows = self.tables[fact]
        if "date_month" in rows.columns:
            month = rows.agg(F.max("date_month")).first()[0]
            rows = rows.where(F.col("date_month") == F.lit(month)) if month is not None else rows
        top = rows.agg(F.max("date_key")).first()[0]
        if top is None:
            raise ValueError(f"{fact} has no dated rows")
        return self.calendar_start + timedelta(days=top - 1)

    def _sliced(
        self,
        fact: str,
        where: Mapping[str, Column],
        period: tuple[date, date] | None,
    ) -> DataFrame:
        rows = self.tables[fact]
        if period:
            low, high = (date_key_of(d, self.calendar_start) for d in period)
            rows = rows.where(F.col("date_key").between(low, high))
            if "date_month" in rows.columns:
                first, last = (d.year * 100 + d.month for d in period)
                rows = rows.where(F.col("date_month").between(first, last))
        for table, condition in where.items():
            if table == fact:
                rows = rows.where(condition)
            else:
                key = self._key(fact, table)
                kept = self.tables[table].where(condition).select(key)
                rows = rows.join(kept, key, "left_semi")
        return rows

    def _aggregate(
        self,
        fact: str,
        bases: Sequence[str],
        by: Sequence[tuple[str, str]],
        where: Mapping[str, Column],
        period: tuple[date, date] | None,
    ) -> DataFrame:
        if self.rollups is not None:
            stored = self.rollups.answer(self, fact, bases, by, where, period)
            if stored is not None:
                return stored
        rows = self._sliced(fact, where, period)
        parts = {f"__{b}": MEASURES[b].base for b in bases}
        if not by:
            return rows.agg(*[b.aggregate().alias(n) for n, b in parts.items()])

        dims: dict[str, list[str]] = {}
        for table, column in by:
            dims.setdefault(table, []).append(column)
        keys = [self._key(fact, d) for d in dims]
        attributes = [column for _, column in by]

        # The counted value gets a new name: its column may also be a key.
        counted = {n: b.row_value().alias(f"__v{n}") for n, b in parts.items() if b.kind == "distinct"}
        added = {n: b for n, b in parts.items() if b.kind != "distinct"}
        rows = rows.select("*", *counted.values()).groupBy(*keys, *[f"__v{n}" for n in counted])
        # without sums, the groups themselves are the distinct combinations
        rows = rows.agg(F.count(F.lit(1)).alias("__rows"), *[b.aggregate().alias(n) for n, b in added.items()])
        final = [
            (F.count_distinct(f"__v{n}") if b.kind == "distinct" else F.sum(n)).alias(n) for n, b in parts.items()
        ]

        for dim, columns in dims.items():
            key = self._key(fact, dim)
            rows = rows.join(self.tables[dim].select(key, *columns), key, "left")
        return rows.groupBy(*attributes).agg(*final)

    def query(
        self,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Mapping[str, Column] | None = None,
        period: tuple[date, date] | None = None,
        order_by: Sequence[Column] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Measures by dimension columns.

        ``by`` holds names like ``dim_brand.brand_name``; the output column is the part
        after the dot. ``where`` maps a table to a condition on its columns. With an order,
        the grouping columns are appended to it, so that ties are settled.
        """
        wanted = [measure(m) for m in measures]
        groups = [tuple(b.split(".", 1)) for b in by]
        names = [column for _, column in groups]
        if len(set(names)) != len(names):
            raise ValueError(f"grouping columns share a name: {names}")

        # Roll-ups keep sums and sets in different tables; the fact has both.
        per_fact: dict[tuple[str, bool], list[str]] = {}
        for m in wanted:
            for b in _bases_of(m):
                base = MEASURES[b].base
                apart = self.rollups is not None and base.kind == "distinct"
                found = per_fact.setdefault((base.fact, apart), [])
                if b not in found:
                    found.append(b)
        frames = [
            self._aggregate(fact, bases, groups, where or {}, period)
            for (fact, _), bases in per_fact.items()
        ]
        if len(frames) == 1:
            joined = frames[0]
        elif names:
            joined = drill_across(frames, names)
        else:
            # One row each, with different columns: stack them and keep what is not null.
            stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            joined = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
        result = joined.select(*names, *[_finished(m).alias(m.name) for m in wanted])
        if order_by:
            result = result.orderBy(*order_by, *[F.col(n).asc_nulls_first() for n in names])
        return result if limit is None else result.limit(limit)

    def evaluate(self, name: str, **slice_) -> DataFrame:
        """(measure, value) of one measure as a double; 0 when there is nothing to add up."""
        m = measure(name)
        value = F.coalesce(F.col(m.name).cast("double"), F.lit(0.0))
        return self.query([m.name], **slice_).select(
            F.lit(m.title).alias("measure"), value.alias("value")
        )


def displayed(result: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Adds a text column ``<measure>_text`` per measure, in its display format."""
    found = [measure(m) for m in measures]
    return result.withColumns({f"{m.name}_text": DISPLAY[m.display](F.col(m.name)) for m in found})


# --- reconciliation ---------------------------------------------------------------------

RECONCILED = (
    "page_views",
    "sessions",
    "mrr",
    "active_subscribers",
    "new_subscribers",
    "churned_subscribers",
    "ad_revenue",
    "ad_impressions",
    "ad_clicks",
)


def _unpivot(row: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """(measure, value) rows from a one-row table of measures."""
    pairs = [
        F.struct(F.lit(t).alias("measure"), F.col(c).cast("double").alias("value"))
        for c, t in titles.items()
    ]
    return row.select(F.inline(F.array(*pairs)))


def _stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _reconciled_by_fact() -> dict[str, list[str]]:
    facts: dict[str, list[str]] = {}
    for name in RECONCILED:
        facts.setdefault(MEASURES[name].base.fact, []).append(name)
    return facts


def measured_values(model: StarModel) -> DataFrame:
    """(measure, value) of the reconciled measures through the measure layer: one
    aggregate per fact, as its measures share a scan."""
    return _stacked(
        [
            _unpivot(model.query(names), {n: MEASURES[n].title for n in names})
            for names in _reconciled_by_fact().values()
        ]
    )


# The same figures, stated independently as SQL over the fact tables.
RECONCILE_SQL = {
    "fct_engagement": {
        "Page Views": "sum(page_views)",
        "Sessions": "sum(sessions)",
    },
    "fct_subscription": {
        "MRR": "sum(mrr)",
        "Active Subscribers": "count(DISTINCT subscriber_key) FILTER (WHERE active_flag = 1)",
        "New Subscribers": "count_if(new_flag = 1)",
        "Churned Subscribers": "count_if(churned_flag = 1)",
    },
    "fct_ad": {
        "Ad Revenue": "sum(ad_revenue)",
        "Ad Impressions": "sum(impressions)",
        "Ad Clicks": "sum(clicks)",
    },
}


def expected_values(
    tables: Mapping[str, DataFrame], wanted: Mapping[str, Mapping[str, str]] = RECONCILE_SQL
) -> DataFrame:
    """(measure, value) of the reconciled measures in SQL."""
    frames = []
    for fact, texts in wanted.items():
        columns = {f"m{i}": (title, text) for i, (title, text) in enumerate(texts.items())}
        row = tables[fact].agg(*[F.expr(text).alias(c) for c, (_, text) in columns.items()])
        frames.append(_unpivot(row, {c: title for c, (title, _) in columns.items()}))
    return _stacked(frames)
