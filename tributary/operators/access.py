"""Access to tables: rows that a session may see, pages of results, optional filters."""

from __future__ import annotations

import re
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def visible(rows: DataFrame, subscriptions: DataFrame, key: str) -> DataFrame:
    """Row-level security: only rows whose key the session is subscribed to."""
    return rows.join(subscriptions.select(key).distinct(), key, "left_semi")


def parse_window(window: str | None) -> timedelta:
    """`30m`, `3h` or `7d`; an hour if there is none; ValueError for the rest."""
    if not window:
        return timedelta(hours=1)
    found = re.fullmatch(r"(\d+)([mhd])", window.strip().lower())
    if not found or not int(found[1]):
        raise ValueError(f"no window: {window!r}")
    return timedelta(**{_UNITS[found[2]]: int(found[1])})


def where_given(df: DataFrame, **predicates: Column | None) -> DataFrame:
    """The predicates that are given, all of them."""
    return reduce(DataFrame.where, [p for p in predicates.values() if p is not None], df)


def any_ilike(columns: list[str], needle: str) -> Column:
    """Whether any column holds the text, whatever its case."""
    return reduce(Column.__or__, [F.col(c).ilike(f"%{needle}%") for c in columns])


def payload_filter(conditions: dict[str, object]) -> Column:
    """Equality for single values, any-of for lists, {'range': {'gte': .., 'lte': ..}}. (P10)"""
    out = F.lit(True)
    for name, value in conditions.items():
        if isinstance(value, dict):
            bounds = value.get("range", {})
            for op, bound in bounds.items():
                c = F.col(name)
                out = out & {"gte": c >= bound, "gt": c > bound, "lte": c <= bound, "lt": c < bound}[op]
        elif isinstance(value, (list, tuple)):
            out = out & F.col(name).isin(list(value))
        else:
            out = out & (F.col(name) == value)
    return out


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of the rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
