"""Landing of immutable JSON Lines batches, each with a manifest written after it.

``<root>/<source>/ingest_date=YYYY-MM-DD/<source>_<stamp>.jsonl`` has ``_manifest_<stamp>.json`` beside it (source, file,
records, sha256, extracted_at, ...) and, once its contract was checked, ``_verdict_<stamp>.json`` (state, sha256,
critical_failures). A batch that equals the last one isn't written again: a heartbeat manifest without a file tells that
the source is alive. Sidecars are small and hidden from Spark's readers, so the driver reads those of the files at hand
through the file system API, wherever the landing folder is.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
SIDECAR_SCHEMA = (
    "path string, manifest string, verdict string, manifest_sha256 string, records long, extracted_at string, heartbeat boolean, "
    "verdict_state string, verdict_sha256 string, critical_failures array<string>"
)


def sidecar(path: str, kind: str) -> str:
    """The path of a data file's manifest or verdict."""
    folder, name = path.rsplit("/", 1)
    return f"{folder}/_{kind}_{name.rsplit('.', 1)[0].rsplit('_', 1)[1]}.json"


def _read(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file; an existing one is an error, batches are immutable."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    try:
        stream.write(data)
    finally:
        stream.close()


def sidecars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What manifests and verdicts say of the given data files; nulls where there is none."""
    rows = []
    for path in paths:
        m, v = _read(spark, sidecar(path, "manifest")), _read(spark, sidecar(path, "verdict"))
        a, b = json.loads(m) if m else {}, json.loads(v) if v else {}
        rows.append((path, m, v, a.get("sha256"), a.get("records"), a.get("extracted_at"), bool(a.get("heartbeat")), b.get("state"), b.get("sha256"), b.get("critical_failures")))
    return spark.createDataFrame(rows, SIDECAR_SCHEMA)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Whole data files as they arrive."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder)


def ingest_date(path: Column) -> Column:
    """The date in the path, null without one."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"ingest_date=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def lines(batch: DataFrame) -> DataFrame:
    """path, sha256, ingest_date, line (from 0, blank ones counted), payload of each line that isn't blank."""
    text = F.decode("content", "utf-8")
    split = batch.select("path", F.sha2("content", 256).alias("sha256"), ingest_date(F.col("path")).alias("ingest_date"), F.posexplode(F.split(text, "\n")).alias("line", "payload"))
    return split.filter(F.trim(F.regexp_replace("payload", r"\s", "")) != "")


def describe_files(batch: DataFrame) -> DataFrame:
    """path, sha256 and n_lines of each file."""
    text = F.decode("content", "utf-8")
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s", "") != ""))
    return batch.select("path", F.sha2("content", 256).alias("sha256"), filled.cast("long").alias("n_lines"))


def sorted_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON with its fields by name, so that equal content gives equal bytes."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def content_hash(df: DataFrame) -> str:
    """Hash of a table's rows in any order: of the sorted hashes of its rows' first digits, so that no task holds all rows."""
    rows = sorted_json(df).select(F.sha2("value", 256).alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    seen = sorted((r["part"], str(r["s"]), r["n"]) for r in parts.collect())  # at most 256 rows
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def publish(spark: SparkSession, source: str, records: list[dict], root: str, stamp: str, extracted_at: str, last: dict | None, extra: dict | None = None) -> dict:
    """Lands one extraction of a producer (as large as the producer's memory) and returns its manifest, or a heartbeat if the
    bytes equal the last batch's. Data first, then the manifest."""
    data = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False, default=str) + "\n" for r in records).encode()
    digest = hashlib.sha256(data).hexdigest()
    folder = f"{root}/{source}/ingest_date={stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}"
    manifest = {"source": source, "extracted_at": extracted_at, **(extra or {})}
    if last and last.get("sha256") == digest:
        manifest |= {"file": None, "records": 0, "sha256": digest, "heartbeat": True, "last_file": last.get("file") or last.get("last_file")}
    else:
        manifest |= {"file": f"{source}_{stamp}.jsonl", "records": len(records), "sha256": digest}
        _write(spark, f"{folder}/{source}_{stamp}.jsonl", data)
    _write(spark, f"{folder}/_manifest_{stamp}.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def newest_manifest(spark: SparkSession, folder: str, partitions: int = 2) -> str | None:
    """The latest stamp among the manifests of the last partitions."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted((s.getPath().toString() for s in fs.listStatus(p) if "ingest_date=" in s.getPath().getName()), reverse=True)[:partitions]
    stamps = [m[1] for d in days for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(d)) if (m := re.fullmatch(r"_manifest_(\w+)\.json", s.getPath().getName()))]
    return max(stamps, default=None)
