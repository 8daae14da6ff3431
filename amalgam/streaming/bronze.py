"""Landed files into a raw table: file micro-batches, each file classified before its lines enter.

A file without a manifest, or without a verdict on this very content, fails the micro-batch: the checkpoint stays, and the
retry delivers the file again. Replayed files change nothing: lines are keyed by content hash and line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.upsert import guarded_update, insert_only, new_rows
from ..sources import landing
from ..storage import SnapshotTable

INGESTED, DUPLICATE, ERROR, QUARANTINED = "ingested", "duplicate", "error", "quarantined"
#: States of a logged file that a replay doesn't touch.
FINAL = (INGESTED, "reviewed")


class NotReady(RuntimeError):
    """A file's manifest or verdict isn't there yet; to be retried."""


def readiness(files: DataFrame) -> DataFrame:
    """path and what it waits for, of files that can't be classified. ``files``: describe_files joined with sidecars."""
    lacks = (
        F.when(F.col("manifest").isNull(), "no manifest yet")
        .when(F.col("verdict").isNull(), "no verdict yet")
        .when(~F.col("verdict_sha256").eqNullSafe(F.col("sha256")), "the verdict is on other content")
    )
    return files.withColumn("waits_for", lacks).filter("waits_for IS NOT NULL").select("path", "waits_for")


def _name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Adds state and reason: the first that holds of quarantined by contract, error (hash, then line count), duplicate of an
    ingested file or of an earlier path in the batch, ingested. ``ingested``: (sha256, path)."""
    before = ingested.select(F.col("sha256").alias("__sha"), F.col("path").alias("__path"))
    early = (
        F.when(F.col("verdict_state") == "quarantined", QUARANTINED)
        .when(~F.col("manifest_sha256").eqNullSafe(F.col("sha256")), ERROR)
        .when(F.col("records").isNotNull() & (F.col("records") != F.col("n_lines")), ERROR)
    )
    judged = files.withColumn("__early", early).join(before, F.col("sha256") == F.col("__sha"), "left")
    # of files with one content the first that passes is the original
    group = Window.partitionBy("sha256")
    first = F.min(F.when(F.col("__early").isNull(), F.col("path"))).over(group)
    origin = F.coalesce("__path", first)
    repeated = F.col("__early").isNull() & (origin != F.col("path"))
    reason = (
        F.when(F.col("verdict_state") == "quarantined", F.concat(F.lit("contract: "), F.array_join(F.coalesce("critical_failures", F.array().cast("array<string>")), ", ")))
        .when(~F.col("manifest_sha256").eqNullSafe(F.col("sha256")), "hash differs from the manifest's")
        .when(F.col("__early") == ERROR, F.concat(F.col("n_lines").cast("string"), F.lit(" lines, the manifest says "), F.col("records").cast("string")))
        .when(repeated, F.concat(F.lit("same content as "), F.element_at(F.split(origin, "/"), -1)))
    )
    state = F.coalesce("__early", F.when(repeated, DUPLICATE).otherwise(INGESTED))
    return judged.withColumn("state", state).withColumn("reason", reason).drop("__early", "__sha", "__path")


def raw_lines(batch: DataFrame, accepted: DataFrame, source: str) -> DataFrame:
    """The lines of accepted files with their origin."""
    kept = landing.lines(batch).join(F.broadcast(accepted.select("path", "manifest")), "path")
    return kept.select(F.lit(source).alias("source"), "payload", "line", "sha256", _name("path").alias("file"), "manifest", "ingest_date")


def ingest_batch(batch: DataFrame, source: str, raw: SnapshotTable, log: SnapshotTable) -> None:
    """One micro-batch into the raw table and the log. Sidecars of its files, and their states, are small: a batch lists files,
    not rows."""
    spark = batch.sparkSession
    described = landing.describe_files(batch).cache()
    paths = [r["path"] for r in described.select("path").collect()]
    if not paths:
        return
    known = described.join(landing.sidecars(spark, paths), "path")
    waiting = readiness(known).orderBy("path").collect()
    if waiting:
        raise NotReady("; ".join(f"{r['path']}: {r['waits_for']}" for r in waiting))
    done = log.read().filter(F.col("state") == INGESTED) if log.exists() else spark.createDataFrame([], "sha256 string, path string")
    states = classify(known, done.select("sha256", "path")).select(
        F.lit(source).alias("source"), "path", _name("path").alias("file"), "manifest", "sha256", F.col("n_lines").alias("records"),
        F.try_to_timestamp("extracted_at").alias("extracted_at"), "state", "reason",
    ).cache()
    lines = raw_lines(batch, states.filter(F.col("state") == INGESTED), source)
    raw.upsert(lines, lambda now, new: insert_only(now, new, ["sha256", "line"]))
    log.upsert(states, lambda now, new: guarded_update(now, new, ["source", "path"], ~F.col("state").isin(*FINAL)))
    states.unpersist()
    described.unpersist()


def ingest(spark: SparkSession, source: str, folder: str, tables: str) -> None:
    """Everything that landed since the last call, then stops."""
    raw, log = SnapshotTable(spark, f"{tables}/raw_{source}"), SnapshotTable(spark, f"{tables}/ingestion_log")
    query = (
        landing.file_stream(spark, f"{folder}/{source}").writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, source, raw, log))
        .option("checkpointLocation", f"{tables}/checkpoints/{source}").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def heartbeats(sidecars: DataFrame) -> DataFrame:
    """Manifests that tell a source is alive without new data."""
    return sidecars.filter("heartbeat")


def ledger(spark: SparkSession, tables: str) -> SnapshotTable:
    """Batches (source, sha256, rows) that a later stage has finished."""
    return SnapshotTable(spark, f"{tables}/processed_batches")


def mark_processed(table: SnapshotTable, batches: DataFrame) -> None:
    """The last step of a stage: what it marks isn't read again."""
    table.upsert(batches, lambda now, new: insert_only(now, new, ["source", "sha256"]))


def quarantine(table: SnapshotTable, rows: DataFrame) -> None:
    """Adds rejected lines (source, file, line, reason, ...) once each."""
    table.upsert(rows, lambda now, new: insert_only(now, new, ["source", "file", "line", "reason"]))


__all__ = ["NotReady", "classify", "heartbeats", "ingest", "ingest_batch", "ledger", "mark_processed", "new_rows", "quarantine", "readiness"]
