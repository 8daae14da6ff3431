"""Arrival contracts and data tests: counts of violating rows, and what they mean for a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``count``: a DataFrame of one row, column ``failed``, for a batch. ``critical``: a failure quarantines the batch."""

    name: str
    count: Callable[[DataFrame], DataFrame]
    critical: bool = True
    needs: tuple[str, ...] = ()


def _rows(condition: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("failed"))


def not_missing(column: str, critical: bool = True) -> Check:
    return Check(f"missing {column}", _rows(F.col(column).isNull()), critical, (column,))


def accepted(column: str, values: list, critical: bool = True) -> Check:
    """A null isn't an invalid value; ``not_missing`` is for that."""
    return Check(f"values {column}", _rows(~F.col(column).isin(values)), critical, (column,))


def matches(column: str, pattern: str, critical: bool = True) -> Check:
    return Check(f"format {column}", _rows(~F.col(column).rlike(pattern)), critical, (column,))


def within(column: str, low=None, high=None, critical: bool = True) -> Check:
    bad = [F.col(column) < low] * (low is not None) + [F.col(column) > high] * (high is not None)
    return Check(f"range {column}", _rows(reduce(lambda a, b: a | b, bad)), critical, (column,))


def unique(columns: list[str], critical: bool = True) -> Check:
    """Fails by the number of rows beyond the first of their key."""
    count = lambda df: df.groupBy(*columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failed"))
    return Check(f"unique {', '.join(columns)}", count, critical, tuple(columns))


def no_row(name: str, condition: Column, critical: bool = True, needs: tuple[str, ...] = ()) -> Check:
    return Check(name, _rows(condition), critical, needs)


def row_count(low: int, high: int, critical: bool = False) -> Check:
    return Check("row count", lambda df: df.agg((~F.count(F.lit(1)).between(low, high)).cast("long").alias("failed")), critical)


def fresh(column: str, as_of: Column, hours: float, critical: bool = False) -> Check:
    """The newest row is at most so old at ``as_of``, the batch's own time, so that a check gives the same later. Empty fails."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.max(column).cast("timestamp"))
    return Check(f"fresh {column}", lambda df: df.agg((~F.coalesce(age <= hours * 3600, F.lit(False))).cast("long").alias("failed")), critical, (column,))


def has_columns(columns: list[str], critical: bool = True) -> Check:
    """More columns, and any order, are fine."""
    return Check("schema", lambda df: df.sparkSession.range(1).select(F.lit(len(set(columns) - set(df.columns))).cast("long").alias("failed")), critical)


def related(column: str, parent: DataFrame, parent_column: str, critical: bool = True) -> Check:
    """Every value that is known exists in the parent."""
    p = parent.select(F.col(parent_column).alias("__p")).distinct()
    count = lambda df: df.filter(F.col(column).isNotNull()).join(p, F.col(column) == F.col("__p"), "left_anti").agg(F.count(F.lit(1)).alias("failed"))
    return Check(f"related {column}", count, critical, (column,))


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """check, critical, failed (null if a column it needs is absent), outcome: pass, warn, fail or not evaluated."""
    out = []
    for c in checks:
        if set(c.needs) - set(df.columns):
            counted = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("failed"))
        else:
            counted = c.count(df)
        out.append(counted.select(F.lit(c.name).alias("check"), F.lit(c.critical).alias("critical"), F.col("failed").cast("long").alias("failed")))
    outcome = F.when(F.col("failed").isNull(), "not evaluated").when(F.col("failed") == 0, "pass").otherwise(F.when(F.col("critical"), "fail").otherwise("warn"))
    return reduce(DataFrame.unionByName, out).withColumn("outcome", outcome)


def verdict(results: DataFrame) -> DataFrame:
    """One row: state (approved or quarantined), critical_failures, warnings. A critical check not evaluated has failed."""
    bad = F.col("critical") & F.col("outcome").isin("fail", "not evaluated")
    advice = ~F.col("critical") & (F.col("outcome") != "pass")
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("check"))))
    return results.agg(F.when(F.count_if(bad) > 0, "quarantined").otherwise("approved").alias("state"), named(bad).alias("critical_failures"), named(advice).alias("warnings"))


def freshness_state(age_hours: Column, warn: Column, error: Column) -> Column:
    """ok, warn or error; no age at all is an error."""
    return F.when(age_hours.isNull() | (age_hours > error), "error").when(age_hours > warn, "warn").otherwise("ok")
