"""Column expressions shared by all layers. Everything here stays in Catalyst; no UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


# --- typing ---------------------------------------------------------------------------


def enforce(df: DataFrame, types: Mapping[str, str], lenient: bool = False) -> DataFrame:
    """Cast the named columns in one projection.

    With ``lenient`` a value that does not parse becomes null; otherwise it is an error,
    as Spark 4 runs in ANSI mode.
    """
    cast = (lambda c, t: c.try_cast(t)) if lenient else (lambda c, t: c.cast(t))
    return df.withColumns({name: cast(F.col(name), t) for name, t in types.items()})


def as_boolean(column: Column) -> Column:
    """Boolean from a boolean or from its text form ('true' / 'false')."""
    return column.cast("boolean")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("int")


def with_audit(df: DataFrame, name: str = "load_timestamp") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def as_day(column: Column) -> Column:
    """Calendar day of a timestamp, in the session time zone (UTC by default)."""
    return F.to_date(column)


# --- numbers --------------------------------------------------------------------------


def safe_ratio(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    """numerator / denominator * scale, and 0 when the denominator is zero or null."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(ratio, F.lit(0.0)) * F.lit(scale)


def relative_difference(value: Column, base: Column) -> Column:
    """|value - base| / |base|; null when base is 0."""
    return F.try_divide(F.abs(value - base), F.abs(base))


def price_of(plan: Column, prices: Mapping[str, float], default: float) -> Column:
    """Price by plan; plans outside the table get the default."""
    branches = F
    for name, price in prices.items():
        branches = branches.when(plan == name, F.lit(price))
    return branches.otherwise(F.lit(default))


# --- text -----------------------------------------------------------------------------


def prefixed_id(prefix: str, number: Column, width: int) -> Column:
    """'CNT' + zero-padded number.

    ``lpad`` also cuts longer text, which would make different ids equal, so a number
    wider than ``width`` is kept whole.
    """
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def display_count(column: Column) -> Column:
    return F.format_number(column, 0)


def display_decimal(column: Column) -> Column:
    return F.format_number(column, 2)


def _bracketed(column: Column, digits: int) -> Column:
    text = F.concat(F.lit("$"), F.format_number(F.abs(column), digits))
    return F.when(column < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def display_money(column: Column) -> Column:
    """Whole currency units, negative amounts in brackets."""
    return _bracketed(column, 0)


def display_money_cents(column: Column) -> Column:
    return _bracketed(column, 2)


def display_percent(column: Column) -> Column:
    """The value already is a percentage; it is not multiplied again."""
    return F.concat(F.call_function("format_number", column, F.lit("0.00")), F.lit("%"))


DISPLAY = {
    "#,##0": display_count,
    "#,##0.00": display_decimal,
    "$#,##0": display_money,
    "$#,##0.00": display_money_cents,
    "0.00%": display_percent,
}


# --- dates ----------------------------------------------------------------------------


def calendar_columns(day: Column) -> dict[str, Column]:
    """Attributes of a day, for a date dimension."""
    name = F.date_format(day, "EEEE")
    return {
        "full_date": day,
        "date": day,
        "date_int": F.date_format(day, "yyyyMMdd").cast("int"),
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "day": F.dayofmonth(day),
        "day_of_month": F.dayofmonth(day),
        "weekday": name,
        "day_name": name,
        "day_of_week": F.weekday(day) + 1,
        "is_weekend": F.weekday(day) >= 5,
    }


def at_time(day: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    return day.cast("timestamp") + F.make_dt_interval(F.lit(0), hours, minutes, seconds)


# --- reproducible draws ---------------------------------------------------------------

# Integer arithmetic modulo the Mersenne prime 2^31 - 1. A draw depends on the row id and
# a salt only, so it is the same whatever the partitioning and after any retry, which
# ``rand(seed)`` does not promise. The fifth power is a permutation of the residues and
# breaks the straight line that neighbouring ids would otherwise form.
DRAW_PRIME = 2147483647
DRAW_ID_FACTOR = 48271
DRAW_SALT_FACTOR = 69621


def with_draws(
    df: DataFrame, row_id: str, salts: Mapping[str, int], prefix: str = "draw_"
) -> DataFrame:
    """Adds one column ``draw_<name>`` per salt: a reproducible integer in [0, 2^31 - 1).

    The powers are built in steps, each a projection of its own. As one expression the
    first residue would be written out ten times.
    """
    prime = F.lit(DRAW_PRIME)
    number = F.col(row_id).cast("long")
    residue = F.pmod(number, prime)
    # Ids a multiple of the prime apart share a residue; the quotient, weighted by each start,
    # keeps their draws apart.
    turn = F.pmod(F.expr(f"cast(`{row_id}` as bigint) div {DRAW_PRIME}"), prime)
    starts = {n: salt * DRAW_SALT_FACTOR % DRAW_PRIME for n, salt in salts.items()}
    x, square = "__x_{}".format, "__s_{}".format
    first = df.withColumns(
        {
            x(n): F.pmod(residue * DRAW_ID_FACTOR + F.lit(start) + F.pmod(turn * F.lit(start + 1), prime), prime)
            for n, start in starts.items()
        }
    )
    second = first.withColumns({square(n): F.pmod(F.col(x(n)) * F.col(x(n)), prime) for n in salts})
    last = second.withColumns(
        {
            prefix + n: F.pmod(F.pmod(F.col(square(n)) * F.col(square(n)), prime) * F.col(x(n)), prime)
            for n in salts
        }
    )
    return last.drop(*[x(n) for n in salts], *[square(n) for n in salts])


def drawn_int(draw: Column, low: int, high: int | Column) -> Column:
    """Integer in [low, high], both ends included; the upper end may be a count of rows."""
    return (F.lit(low) + F.pmod(draw, F.lit(high - low + 1))).cast("int")


def drawn_choice(draw: Column, values: Sequence[str]) -> Column:
    """One of a short list of values."""
    index = (F.pmod(draw, F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def drawn_fraction(draw: Column) -> Column:
    """Double in [0, 1)."""
    return draw.cast("double") / F.lit(float(DRAW_PRIME))


def drawn_between(draw: Column, low: float, high: float) -> Column:
    """Double in [low, high)."""
    return F.lit(low) + drawn_fraction(draw) * F.lit(high - low)


# --- predicates -----------------------------------------------------------------------


def not_true(condition: Column) -> Column:
    """Rows for which a rule does not hold; an unknown (null) result counts as holding."""
    return F.coalesce(~condition, F.lit(False))
