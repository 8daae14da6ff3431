"""Merges of new rows into a stored table, as the next version of that table.

Spark's Parquet tables have no MERGE. Each function here is a plan that reads the current table and the source and gives
the whole next one; ``storage.SnapshotTable.upsert`` writes it beside the current version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import null_safe
from .selection import latest


def _without(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key isn't in ``source``; null keys are equal."""
    s = source.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = [target[k].eqNullSafe(s[f"__{k}"]) for k in keys]
    return target.join(s, same, "left_anti")


def full_sync(target: DataFrame, source: DataFrame, keys: list[str], delete_missing: bool = True) -> DataFrame:
    """The source's rows replace those of their keys; others stay unless ``delete_missing``."""
    if delete_missing:
        return source.select(target.columns)
    return _without(target, source, keys).unionByName(source.select(target.columns))


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key isn't stored yet, one for each key; stored rows never change."""
    return target.unionByName(new_rows(target, source, keys).select(target.columns))


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``insert_only`` adds. Of several with one key, the first by all columns."""
    rest = [F.col(c) for c in source.columns if c not in keys]
    return latest(_without(source, target, keys), keys, rest or [F.lit(0)])


def guarded_update(target: DataFrame, source: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """Like ``full_sync`` without deletes, but a stored row that ``guard`` (over its columns) doesn't allow to change stays."""
    frozen = target.filter(~F.coalesce(guard, F.lit(False)))
    return frozen.unionByName(_without(target.filter(F.coalesce(guard, F.lit(False))), source, keys)).unionByName(
        _without(source, frozen, keys).select(target.columns)
    )


def winners(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``source`` (one for each key) that replace or add: nothing is stored, what is stored has no order, or the new
    order is known and not older."""
    stored = target.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(order).alias("__stored"), F.lit(True).alias("__there"))
    same = [source[k].eqNullSafe(stored[f"__{k}"]) for k in keys]
    wins = F.col("__there").isNull() | F.col("__stored").isNull() | F.coalesce(F.col(order) >= F.col("__stored"), F.lit(False))
    return source.join(stored, same, "left").filter(wins).select(source.columns)


def last_writer_wins(target: DataFrame, source: DataFrame, keys: list[str], order: str, ties: list[str] = ()) -> DataFrame:
    """Upsert in which an older snapshot can't overwrite a newer one. Of several source rows with one key the newest counts,
    nulls last, then the greatest by ``ties``."""
    newest = latest(source, keys, [F.col(order).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)])
    won = winners(target, newest, keys, order)
    return _without(target, won, keys).unionByName(won.select(target.columns))


def replace_children(target: DataFrame, children: DataFrame, parents: DataFrame, parent_keys: list[str], keys: list[str]) -> DataFrame:
    """The children of the given parents become exactly ``children`` (repeated ones once); those of others stay."""
    once = latest(children, keys, [F.col(c) for c in children.columns if c not in keys] or [F.lit(0)])
    return _without(target, parents, parent_keys).unionByName(once.select(target.columns))


def child_rows_to_delete(target: DataFrame, children: DataFrame, parents: DataFrame, parent_keys: list[str], keys: list[str]) -> DataFrame:
    """Stored children of the given parents that ``children`` no longer has."""
    p = parents.select(*(F.col(k).alias(f"__{k}") for k in parent_keys)).distinct()
    mine = target.join(p, [target[k].eqNullSafe(p[f"__{k}"]) for k in parent_keys], "left_semi")
    return _without(mine, children, keys)


def merge_actions(target: DataFrame, source: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), scope: Column | None = None) -> DataFrame:
    """Every key with its action: insert, update (a column outside ``ignore`` differs, null-safe), keep, delete (stored, in
    ``scope``, and not in the source). The source's columns of a key that is kept or deleted are the stored ones.

    Columns: those of ``target``, action.
    """
    compared = [c for c in target.columns if c not in keys and c not in ignore]
    t = target.select(*(F.col(c).alias(f"__t_{c}") for c in target.columns), F.lit(True).alias("__t"), F.coalesce(scope if scope is not None else F.lit(True), F.lit(False)).alias("__scope"))
    s = latest(source, keys, [F.col(c).desc_nulls_last() for c in source.columns if c not in keys] or [F.lit(0)]).withColumn("__s", F.lit(True))
    both = s.join(t, [s[k].eqNullSafe(t[f"__t_{k}"]) for k in keys], "full")
    same = F.struct(*(F.col(c) for c in compared)).eqNullSafe(F.struct(*(F.col(f"__t_{c}").alias(c) for c in compared))) if compared else F.lit(True)
    action = (
        F.when(F.col("__t").isNull(), "insert")
        .when(F.col("__s").isNull(), F.when(F.col("__scope"), "delete").otherwise("keep"))
        .when(same, "keep")
        .otherwise("update")
    )
    return both.withColumn("action", action).select(
        *(F.when(F.col("__s").isNull() | ((F.col("action") == "keep") & F.col("__t").isNotNull()), F.col(f"__t_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns), "action"
    )


def apply_actions(actions: DataFrame) -> DataFrame:
    """The next table of ``merge_actions``."""
    return actions.filter("action <> 'delete'").drop("action")


def pending(batches: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Batches that the ledger doesn't have yet."""
    return _without(batches, processed, keys)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity; column ``side``: left or right."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


__all__ = [
    "apply_actions", "child_rows_to_delete", "differences", "full_sync", "guarded_update", "insert_only", "last_writer_wins", "merge_actions",
    "new_rows", "null_safe", "pending", "replace_children", "winners",
]
