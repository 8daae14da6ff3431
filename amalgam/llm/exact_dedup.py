"""Exact dedup by a heavy-hitter split, with Spark expressions only.

Texts are equal when they are identical after each run of white space becomes one space; null counts as empty. Of
equal texts the row with the smallest ``doc_id`` stays; a null ``doc_id`` comes after all others, and of rows that
share text and ``doc_id`` exactly one stays.

A group of copies may hold a third of the corpus, so a plain shuffle by digest would deal it to one task. The
Misra-Gries summary (Spark's mergeable frequent-items sketch, the decrement-by-median variant of that algorithm) finds
every digest above 4/``TRACKED`` of the rows in one map-side pass. Its at most ``CANDIDATES`` findings are counted
exactly; those verified are broadcast with their winners and their rows leave before the shuffle. What remains has no
group above that share and takes the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, text_or_empty

#: Counters of one sketch, and how many of the most frequent hashes are verified; the broadcast has no more rows.
TRACKED, CANDIDATES = 1024, 512
#: Sketches are merged in two steps, so that no task reads one of every partition.
MERGERS = 64
#: A digest on fewer rows is left to the shuffle.
HEAVY = 32


def text_digest(name: str = "text"):
    return F.sha2(F.regexp_replace(text_or_empty(name), SPACE, " "), 256)


def _order(doc_id: str, row: str | None = None):
    """Sorts first the row that stays."""
    return F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), *([F.col(row).alias("row")] if row else []))


def heavy_digests(digests: DataFrame, order) -> DataFrame:
    """(text_sha256, winner, group_size) of the frequent digests; at most ``CANDIDATES`` rows.

    ``digests`` is read twice, so it should be materialized.
    """
    sketches = (
        digests.select((F.spark_partition_id() % MERGERS).alias("merger"), F.xxhash64("text_sha256").alias("h"))
        .groupBy("merger")
        .agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("sketch"))
    )
    # grouped by a key that is 0 everywhere: a global combine fails on empty partitions
    found = sketches.groupBy(F.floor(F.col("merger") / MERGERS)).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {CANDIDATES})").alias("top"))
    candidates = found.select(F.explode("top.item").alias("candidate"))
    return (
        digests.join(F.broadcast(candidates), F.xxhash64("text_sha256") == F.col("candidate"))
        .groupBy("text_sha256")
        .agg(F.min(order).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= HEAVY)
    )


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. No rows for an empty table."""
    digests = materialize(docs.select("doc_id", text_digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    order = _order("doc_id", "row")
    heavy = materialize(heavy_digests(digests, order), "heavy")
    split = digests.join(F.broadcast(heavy), "text_sha256", "left")
    frequent = split.filter(F.col("group_size").isNotNull())
    rest = Window.partitionBy("text_sha256")
    ordinary = (
        split.filter(F.col("group_size").isNull())
        .select("doc_id", "row", "text_sha256", F.min(order).over(rest).alias("winner"), F.count(F.lit(1)).over(rest).alias("group_size"))
    )
    return frequent.select(ordinary.columns).unionByName(ordinary).select(
        "doc_id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns; only rows outside the heavy groups are shuffled."""
    rows = materialize(docs.withColumns({"__row": F.monotonically_increasing_id(), "__digest": text_digest()}), "rows")
    order = _order("doc_id", "__row")
    heavy = heavy_digests(rows.select(F.col("__digest").alias("text_sha256"), "doc_id", "__row"), order)
    heavy = heavy.select(F.col("text_sha256").alias("__digest"), F.col("winner.row").alias("__winner"))
    survivors = rows.join(F.broadcast(heavy), "__digest", "left").filter(F.col("__winner").isNull() | (F.col("__winner") == F.col("__row")))
    first = Window.partitionBy("__digest").orderBy(order)
    return survivors.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").select(docs.columns)
