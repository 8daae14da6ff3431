"""Change history (SCD type 2) from a change log, with window functions.

A change has an operation (insert, update, update_before, delete), a place in the log (``lsn`` as fixed-width hex text, whose
text order is the log's, and ``seqval``), a commit time and the row. A version opens when an insert or update brings a row
whose hash differs from the open one's, which it closes; an update that changes nothing but technical columns opens none; a
delete closes without opening; images of rows before an update are dropped, and so are changes not after the last one
applied to the key, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TECHNICAL = ("modified_at",)
OPERATIONS = ("insert", "update", "update_before", "delete")


def row_hash(columns: list[str], technical: tuple[str, ...] = TECHNICAL) -> Column:
    """Hash of a row's columns by name; a null differs from an empty text."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c not in technical)), {"ignoreNullFields": "false"}), 256)


def versions(changes: DataFrame, keys: list[str], columns: list[str], stored: DataFrame | None = None, technical: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """keys, columns, hash, op, lsn, seqval, valid_from, valid_to, closed_lsn, closed_seqval: with ``stored`` (the same
    columns), the whole next history. The place that closed a version is kept, so that replayed changes before it open nothing.

    ``changes``: keys, columns, op, lsn, seqval, commit_time. An operation that is none of ``OPERATIONS``, or null, fails the
    query: a change that can't be read must not be lost.
    """
    known = F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation in the change log: "), F.coalesce("op", F.lit("null")))))
    changes = changes.withColumn("op", known)
    out = [*keys, *columns, "hash", "op", "lsn", "seqval", "valid_from", "valid_to", "closed_lsn", "closed_seqval"]
    time = dict(changes.dtypes)["commit_time"]
    place, closed = F.struct("lsn", "seqval"), F.struct(F.col("closed_lsn").alias("lsn"), F.col("closed_seqval").alias("seqval"))
    events = (
        changes.filter("op <> 'update_before'").dropDuplicates([*keys, "lsn", "seqval"])  # a batch may repeat a change
        .select(*keys, *columns, row_hash(columns, technical).alias("hash"), "op", "lsn", "seqval", F.col("commit_time").alias("valid_from"))
        .withColumns({"valid_to": F.lit(None).cast(time), "closed_lsn": F.lit(None).cast("string"), "closed_seqval": F.lit(None).cast("string")})
        .withColumn("__stored", F.lit(False))
    )
    rest = None
    if stored is not None:
        touched = events.select(*(F.col(k).alias(f"__k_{k}") for k in keys)).distinct()
        same = [stored[k].eqNullSafe(touched[f"__k_{k}"]) for k in keys]
        whole = Window.partitionBy(*keys)
        mine = stored.join(touched, same, "left_semi").withColumn("__stored", F.lit(True))
        both = (
            mine.select(*events.columns).unionByName(events)
            .withColumn("__newest", F.max(F.when(F.col("__stored"), place)).over(whole))
            .withColumn("__applied", F.max(F.when(F.col("__stored"), F.when(F.col("closed_lsn").isNotNull(), F.greatest(place, closed)).otherwise(place))).over(whole))
        )
        older = F.col("__stored") & (place < F.col("__newest"))
        rest = stored.join(touched, same, "left_anti").select(out).unionByName(both.filter(older).select(out))
        fresh = ~F.col("__stored") & (F.col("__applied").isNull() | (place > F.col("__applied")))
        events = both.filter((F.col("__stored") & ~older) | fresh).drop("__newest", "__applied")
    log = Window.partitionBy(*keys).orderBy("lsn", "seqval")
    is_stored, deletes = F.col("__stored"), F.col("op") == "delete"
    state = F.when(is_stored, F.when(F.col("valid_to").isNull(), F.col("hash"))).when(~deletes, F.col("hash"))
    opens = ~is_stored & ~deletes & ~F.col("__state").eqNullSafe(F.col("__before"))
    closes = ~is_stored & deletes & F.col("__before").isNotNull()
    steps = (
        events.withColumn("__state", state)
        .withColumn("__before", F.lag("__state").over(log))
        .withColumn("__opens", opens)
        .filter(is_stored | F.col("__opens") | closes)
        .withColumn("__next", F.lead(F.struct("valid_from", "lsn", "seqval")).over(log))
        .filter(is_stored | F.col("__opens"))
    )
    was_closed = F.col("valid_to").isNotNull()
    end = lambda name, kept: F.when(was_closed, F.col(kept)).otherwise(F.col("__next")[name]).alias(kept)
    done = steps.select(*out[:-3], end("valid_from", "valid_to"), end("lsn", "closed_lsn"), end("seqval", "closed_seqval"))
    return done if rest is None else done.unionByName(rest)


def current(history: DataFrame) -> DataFrame:
    """The open versions without the columns that only the history needs."""
    return history.filter("valid_to IS NULL").drop("valid_to", "hash", "op", "lsn", "seqval", "closed_lsn", "closed_seqval")
