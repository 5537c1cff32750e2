"""Filters built from Python values as Column predicates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_CODE_WIDTH = 20


def matches(column: Column, value) -> Column | None:
    """None: no condition; tuple: inclusive range; list: membership; otherwise equality."""
    if value is None:
        return None
    if isinstance(value, tuple):
        low, high = value
        return column.between(low, high)
    if isinstance(value, list):
        return column.isin(value)
    return column == F.lit(value)


def stores(column: Column, value) -> Column | None:
    """A store is one code or any collection of codes."""
    return matches(column, list(value) if isinstance(value, (tuple, set)) else value)


def padded_item_code(jan) -> str:
    """An item code as the zero-padded text of the fact table."""
    code = str(jan)
    if len(code) > ITEM_CODE_WIDTH:
        raise ValueError(f"item code longer than {ITEM_CODE_WIDTH} characters: {code}")
    return code.rjust(ITEM_CODE_WIDTH, "0")


def item_codes(column: Column, value) -> Column | None:
    if value is None:
        return None
    if isinstance(value, (list, tuple, set)):
        return column.isin([padded_item_code(jan) for jan in value])
    return column == F.lit(padded_item_code(value))


def all_of(*conditions: Column | None) -> Column:
    """AND of the given conditions, true when there is none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def where_clause(values: Mapping[str, object]) -> Column:
    """One predicate for a mapping of column name to value."""
    return all_of(*(matches(F.col(name), value) for name, value in values.items()))
