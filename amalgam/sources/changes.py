"""Change tables, watch lists and partitioned archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Operation codes of a change table. Fixed values.
OPERATIONS = {1: "delete", 2: "insert", 3: "update_before", 4: "update"}


class ChangeGap(RuntimeError):
    """Changes between the checkpoint and the oldest retained one are lost."""


def change_range(changes: DataFrame, after: str, upto: str | None = None, lsn: str = "lsn", code: str = "op_code") -> DataFrame:
    """Changes after the checkpoint, up to ``upto``, with their operation named. Fails if the log no longer reaches back."""
    oldest = changes.agg(F.min(lsn)).first()[0]
    if after and oldest is not None and oldest > after and changes.filter(F.col(lsn) <= after).isEmpty() and int(oldest, 16) > int(after, 16) + 1:
        raise ChangeGap(f"the log starts at {oldest}, after the checkpoint {after}")
    names = F.create_map(*(F.lit(x) for kv in OPERATIONS.items() for x in kv))
    window = F.col(lsn) > after if upto is None else (F.col(lsn) > after) & (F.col(lsn) <= upto)
    return changes.filter(window).withColumn("op", names[F.col(code)]).drop(code)


def since_mark(df: DataFrame, delivered: DataFrame, mark: str) -> DataFrame:
    """Rows after the greatest ``mark`` delivered; all, if nothing was."""
    last = delivered.agg(F.max(mark).alias("__last"))
    return df.join(F.broadcast(last), F.col("__last").isNull() | (F.col(mark) > F.col("__last"))).drop("__last")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key wasn't delivered before: overlapping windows of an extraction give each row once."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def fold_bindings(bindings: DataFrame, key: str, single: list[str], many: list[str]) -> DataFrame:
    """One row per key from a row per combination of multi-valued properties: the least known single value, sorted sets."""
    return bindings.groupBy(key).agg(*(F.min(c).alias(c) for c in single), *(F.array_sort(F.collect_set(c)).alias(c) for c in many))


def watch_list(spark: SparkSession, path: str, country: str, id_pattern: str, lists: list[str], drop: list[str] = ()) -> DataFrame:
    """Entries of a CSV list that aren't persons and are of a country or hold an identifier; ``;`` lists become arrays."""
    raw = spark.read.csv(path, header=True, escape='"')
    found = F.regexp_extract_all("identifiers", F.lit(id_pattern), F.lit(0))
    cells = {c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), F.trim), lambda x: x != "")) for c in lists}
    kept = raw.filter(F.col("schema") != "Person").withColumn("ids", F.array_distinct(F.coalesce(found, F.array()))).withColumns(cells)
    return kept.filter(F.array_contains("countries", country) | (F.size("ids") > 0)).drop(*drop)


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names match."""
    return df.select(df.colRegex(f"`{pattern}`"))


def in_country(country: Column, region: Column, code: str) -> Column:
    """Of a country, or of a region of it; null is no."""
    return F.coalesce((country == code) | region.startswith(f"{code}-"), F.lit(False))


class ScanTooLarge(RuntimeError):
    """A scan would read more than allowed."""


def guarded(df: DataFrame, most_bytes: int) -> DataFrame:
    """``df`` if the optimizer's size of its scans, after pruning, is within the allowance."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most_bytes:
        raise ScanTooLarge(f"the scan is {size} bytes; {most_bytes} are allowed")
    return df


def append_by_day(df: DataFrame, path: str, day: str) -> None:
    """Appends to an archive partitioned by day."""
    df.write.partitionBy(day).mode("append").parquet(path)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], block: int = 1 << 24) -> DataFrame:
    """The named columns, as text, of the CSV files inside zip archives. An archive is one task's work, but only its compressed
    bytes and one block of ``block`` bytes are held at a time."""
    import io
    import zipfile

    import pyarrow as pa
    from pyarrow import csv

    def read(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith(".csv"):
                            options = csv.ConvertOptions(include_columns=columns, column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=True)
                            with archive.open(name) as f:
                                yield from csv.open_csv(f, csv.ReadOptions(block_size=block), csv.ParseOptions(newlines_in_values=True), options)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, ", ".join(f"`{c}` string" for c in columns))
