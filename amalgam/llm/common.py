"""What several operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expressions import let
from ..storage import discard, materialize, release, scratch, shared_dir

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within it, Python gets at most so many rows at once: texts are long, and each task holds a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows from literals, without Python on the executors."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    struct = lambda row: F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)))
    some = rows or [(None,) * len(fields)]
    out = spark.range(0, 1, 1, 1).select(F.inline(F.array(*map(struct, some))))
    return out if rows else out.filter(F.lit(False))


__all__ = ["SPACE", "WORD", "arrow_rows", "discard", "documents", "let", "literal_rows", "materialize", "release", "scratch", "shared_dir", "text_or_empty"]
