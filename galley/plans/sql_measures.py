"""Measures in SQL: functions made from the registry of measures.

* One table function per fact, ``<fact>_measures(by)``: all measures of the fact by the named
  attribute of a dimension (``brand``, ``month``, ...), or one row for ``total``.
* One scalar function per ratio, such as ``churn_rate_pct(churned_subscribers,
  active_subscribers)``, for aggregates that a query makes itself.
* ``measure_value(name)``: one measure over all rows.

    SELECT label, churn_rate_pct FROM fct_subscription_measures('brand');
    SELECT plan, arpu(sum(mrr), count(DISTINCT subscriber_key)) FROM ... GROUP BY plan;

They are functions of the session, as a table function cannot be called with the name of a
database, and read the tables of one gold layer. The attribute is a constant, so the branches of
all others are folded away before the fact is read: only the dimension asked for is joined.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from galley.plans.measures import MEASURES, RELATIONSHIPS, Base, Measure

# attribute -> dimension and the text that labels a group
ATTRIBUTES: dict[str, tuple[str, str]] = {
    "brand": ("dim_brand", "brand_name"),
    "platform": ("dim_platform", "platform_name"),
    "section": ("dim_content", "section"),
    "content": ("dim_content", "content_id"),
    "channel": ("dim_subscriber", "acquisition_channel"),
    "plan": ("dim_subscriber", "plan"),
    "campaign": ("dim_campaign", "campaign_id"),
    "month": ("dim_date", "printf('%04d-%02d', year, month)"),
    "year": ("dim_date", "CAST(year AS STRING)"),
}
TOTAL = "total"


def attributes(fact: str) -> dict[str, tuple[str, str]]:
    """The attributes that can group a fact."""
    return {name: held for name, held in ATTRIBUTES.items() if held[0] in RELATIONSHIPS[fact]}


def bases(fact: str) -> dict[str, Base]:
    return {n: m.base for n, m in MEASURES.items() if m.base and m.base.fact == fact}


def ratios(fact: str) -> dict[str, Measure]:
    return {n: m for n, m in MEASURES.items() if m.ratio and m.ratio[0] in bases(fact)}


def _aggregate(base: Base) -> str:
    if base.kind == "sum":
        return f"sum({base.column})"
    if base.kind == "rows":
        return f"sum(CASE WHEN {base.column} = 1 THEN 1 ELSE 0 END)"
    return f"count(DISTINCT {f'CASE WHEN {base.flag} = 1 THEN {base.column} END' if base.flag else base.column})"


def _ratio(top: str, bottom: str, scale: int) -> str:
    return f"coalesce(try_divide(CAST({top} AS DOUBLE), CAST({bottom} AS DOUBLE)), 0D) * {scale}"


def ratio_function(m: Measure) -> str:
    """Scalar function of the two aggregates of a ratio."""
    top, bottom = m.ratio
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {m.name}({top} DOUBLE, {bottom} DOUBLE) RETURNS DOUBLE "
        f"COMMENT '{m.title}' RETURN {_ratio(top, bottom, m.scale)}"
    )


def _values(fact: str) -> dict[str, str]:
    """All measures of a fact as aggregates."""
    own = bases(fact)
    values = {n: f"CAST({_aggregate(b)} AS DOUBLE)" for n, b in own.items()}
    for n, m in ratios(fact).items():
        values[n] = _ratio(*(_aggregate(own[part]) for part in m.ratio), m.scale)
    return values


def _selects(fact: str) -> str:
    return ", ".join(f"{value} AS {n}" for n, value in _values(fact).items())


def table_function(layer: str, fact: str) -> str:
    """All measures of a fact by one of its attributes.

    One branch per attribute: the argument is a constant, so all branches but one are empty
    before the plan is made, and their tables are not read.
    """
    names = [*bases(fact), *ratios(fact)]
    branches = [f"SELECT CAST(NULL AS STRING) AS label, {_selects(fact)} FROM {layer}.{fact} WHERE by = '{TOTAL}' HAVING by = '{TOTAL}'"]
    for name, (dim, text) in attributes(fact).items():
        key = RELATIONSHIPS[fact][dim]
        # columns of the dimension get a name of their own: a fact may have them too
        branches.append(
            f"SELECT label, {_selects(fact)} FROM {layer}.{fact} f LEFT JOIN (SELECT {key} AS __key, {text} AS label FROM {layer}.{dim}) d "
            f"ON f.{key} = d.__key WHERE by = '{name}' GROUP BY label"
        )
    columns = ", ".join(["label STRING", *[f"{n} DOUBLE" for n in names]])
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {fact}_measures(by STRING) RETURNS TABLE({columns}) "
        f"RETURN {' UNION ALL '.join(branches)}"
    )


def value_function(layer: str) -> str:
    """One measure over all rows; 0 when there is nothing to add up, null for an unknown name."""
    branches = [
        f"WHEN '{name}' THEN (SELECT coalesce({value}, 0D) FROM {layer}.{fact})"
        for fact in RELATIONSHIPS
        for name, value in _values(fact).items()
    ]
    return f"CREATE OR REPLACE TEMPORARY FUNCTION measure_value(name STRING) RETURNS DOUBLE RETURN CASE name {' '.join(branches)} END"


def register(spark: SparkSession, layer: str) -> list[str]:
    """Creates all functions over a gold layer; returns their names."""
    texts = {m.name: ratio_function(m) for m in MEASURES.values() if m.ratio}
    texts |= {f"{fact}_measures": table_function(layer, fact) for fact in RELATIONSHIPS}
    texts["measure_value"] = value_function(layer)
    for text in texts.values():
        spark.sql(text)
    return list(texts)
