"""Match quality, weighted means and table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided 95 % quantile of the normal distribution. Fixed value.
Z95 = 1.959963984540054


def wilson_interval(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without observations."""
    p, m = hits / F.nullif(n, F.lit(0)), n.cast("double")
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / scale
    bound = lambda x, empty: F.when(n == 0, F.lit(empty)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return bound(centre - spread, 0.0), bound(centre + spread, 1.0)


def match_quality(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """true_positive, false_positive, false_negative, precision, recall and f1, with Wilson bounds, of each group. Rows whose
    ``actual`` is null are undecided and count for nothing."""
    counted = df.filter(actual.isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(predicted & actual).alias("true_positive"),
        F.count_if(predicted & ~actual).alias("false_positive"),
        F.count_if(~predicted & actual).alias("false_negative"),
    )
    tp, said, true = F.col("true_positive"), F.col("true_positive") + F.col("false_positive"), F.col("true_positive") + F.col("false_negative")
    ratio = lambda n: tp / F.nullif(n, F.lit(0))
    (p_low, p_high), (r_low, r_high) = wilson_interval(tp, said), wilson_interval(tp, true)
    return counted.select(
        "*", ratio(said).alias("precision"), p_low.alias("precision_low"), p_high.alias("precision_high"),
        ratio(true).alias("recall"), r_low.alias("recall_low"), r_high.alias("recall_high"),
        (2 * tp / F.nullif(said + true, F.lit(0))).alias("f1"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of values by weight; null if the weights sum to zero."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def steady_sum(value: Column) -> Column:
    """Sum of doubles that is the same in whatever order the rows come: they are added as decimals of 18 places. A sum that
    doesn't fit, or has a NaN or an infinity in it, is added as doubles."""
    exact = value.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double")), F.sum(value))


def round_product(value: Column, digits: int) -> Column:
    """``round`` of DuckDB: the product with the power of ten, as a double, goes to the nearest integer, halves away from zero.
    Spark's rounds the shortest decimal of the double, so that it has 1.01 for 1.005, and DuckDB 1.0."""
    return F.round(value * 10.0**digits) / F.lit(10.0**digits)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-independent checksum of all columns. The sum is a decimal: 64-bit hashes overflow a long."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("checksum"))
