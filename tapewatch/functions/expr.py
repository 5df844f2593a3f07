"""Small column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(top, bottom)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def filled(text: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(text, F.lit(""))


def hash_fraction(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on nothing but ``parts``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar features of a bar time; Monday is 0."""
    return {
        "Hour": F.hour(ts),
        "DayOfWeek": F.weekday(ts),
        "IsMonday": (F.weekday(ts) == 0).cast("int"),
        "IsFriday": (F.weekday(ts) == 4).cast("int"),
    }


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer does not copy into filters above them.

    A filter on a wide expression is otherwise pushed down as a copy of it, and
    the null checks inferred from that copy multiply with every alias below.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
