"""Picking rows: latest, top, ranges of rows, valid ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (most recent first); pass a unique last column to settle ties."""
    return top(df, keys, order, 1)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def moving(df: DataFrame, value: str, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Mean of the last ``rows`` rows of a key, this one included. It counts rows: gaps between days aren't filled."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(w))


def changes_of(df: DataFrame, value: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose ``value`` differs from the one before within the key, both known: columns before and after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    with_both = df.withColumn("after", value).withColumn("before", F.lag("after").over(w))
    return with_both.filter(F.col("before") != F.col("after"))


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason against them, and those with one, in the column ``reason``."""
    judged = df.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def drop_invalid_elements(df: DataFrame, column: str, valid) -> DataFrame:
    """Keeps the row, drops invalid elements of an array; those dropped are joined in ``<column>_dropped`` (null if none)."""
    bad = F.filter(column, lambda x: ~valid(x))
    return df.withColumn(f"{column}_dropped", F.when(F.size(bad) > 0, F.array_join(bad, ", "))).withColumn(column, F.filter(column, valid))


def unpivot_attributes(df: DataFrame, keys: list[str], attributes: dict[str, Column]) -> DataFrame:
    """One row per attribute: position from 1, attribute, value as text."""
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("attribute"), value.cast("string").alias("value")) for i, (name, value) in enumerate(attributes.items(), 1)]
    return df.select(*keys, F.inline(F.array(*pairs)))


def stratified_split(df: DataFrame, strata: list[str], order: Column, first: str, second: str) -> DataFrame:
    """Halves every stratum in the given order; the first half has the odd row. Column ``part``."""
    by = Window.partitionBy(*strata)
    numbered = df.withColumn("__rank", F.row_number().over(by.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(by))
    half = F.col("__rank") * 2 <= F.col("__n") + 1
    return numbered.withColumn("part", F.when(half, first).otherwise(second)).drop("__rank", "__n")


def stratified_quota(df: DataFrame, strata: list[str], order: Column, quota: int) -> DataFrame:
    """At most ``quota`` rows of every stratum, in the given order."""
    return top(df, strata, [order], quota)
