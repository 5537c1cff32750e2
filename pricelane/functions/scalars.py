"""Column expressions used across the operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den; `default` when den is 0 or NULL (a plain division would raise under ANSI)."""
    return F.when(den != 0, num / den).otherwise(F.lit(default).cast("double"))


def offset_day(day: str, days: int) -> str:
    """An ISO date string moved by a number of days."""
    if not isinstance(day, str):
        raise TypeError(f"an ISO date string is expected, not {type(day).__name__}")
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def offset_day_text(day: Column, days: int) -> Column:
    """The same for a column of ISO date strings."""
    return F.date_format(F.date_add(F.to_date(day, "yyyy-MM-dd"), days), "yyyy-MM-dd")


def day_text(df: DataFrame, name: str) -> Column:
    """UNIX seconds as an ISO date (session time zone); any other type as its string."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd")
    return column.cast("string")


def map_lookup(values: dict, key: Column) -> Column:
    """The entry of a small literal map, NULL for keys it lacks."""
    if not values:
        return F.lit(None).cast("double")
    entries = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*entries), key)


def harmonic_mean(*scores: Column) -> Column:
    """Harmonic mean of positive scores, 0 as soon as one of them is not positive."""
    positive = F.lit(True)
    total = F.lit(0.0)
    for score in scores:
        positive = positive & (score > 0)
        total = total + 1 / score
    return F.when(positive, len(scores) / total).otherwise(F.lit(0.0))
