"""Helpers for building expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas, where Spark shares no subexpressions."""
    return F.transform(F.array(value), body)[0]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def null_safe(left, right, keys) -> Column:
    """Equality of keys in which null equals null; planned as an equi-join."""
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])


def first_match(*cases: tuple[Column, str]) -> Column:
    """The label of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays share an element; false, never null, for empty or null ones."""
    return F.coalesce(F.arrays_overlap(F.coalesce(a, F.array()), F.coalesce(b, F.array())), F.lit(False))


def literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))
