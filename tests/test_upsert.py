import random

import pytest
from pyspark.sql import functions as F

from amalgam.operators import upsert
from amalgam.storage import SnapshotTable

ROW = "k string, o int, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_full_sync(spark):
    old, new = spark.createDataFrame([("a", 1, "x"), (None, 2, "n"), ("c", 3, "z")], ROW), spark.createDataFrame([("a", 9, "y"), (None, 8, "m")], ROW)
    assert rows(upsert.full_sync(old, new, ["k"])) == rows(new)
    assert rows(upsert.full_sync(old, new, ["k"], delete_missing=False)) == sorted([("a", 9, "y"), (None, 8, "m"), ("c", 3, "z")], key=repr)


def test_insert_only_is_idempotent(spark):
    old, new = spark.createDataFrame([("a", 1, "x")], ROW), spark.createDataFrame([("a", 9, "y"), ("b", 2, "q"), ("b", 2, "q")], ROW)
    once = upsert.insert_only(old, new, ["k"])
    assert rows(once) == [("a", 1, "x"), ("b", 2, "q")] == rows(upsert.insert_only(once, new, ["k"]))


def test_guarded_update(spark):
    old, new = spark.createDataFrame([("a", 1, "final"), ("b", 1, "open")], ROW), spark.createDataFrame([("a", 9, "y"), ("b", 9, "y"), ("c", 9, "y")], ROW)
    assert rows(upsert.guarded_update(old, new, ["k"], F.col("v") != "final")) == [("a", 1, "final"), ("b", 9, "y"), ("c", 9, "y")]


def _wins(new, stored):
    return stored is None or (new is not None and new >= stored)


@pytest.mark.parametrize("seed", range(6))
def test_last_writer_wins_in_batches_is_the_whole(spark, seed):
    """However the rows are cut into batches, the result is that of one pass in their order."""
    rng = random.Random(seed)
    batches = [[(rng.choice("ABCDE"), rng.choice([None, 1, 2, 3]), f"{b}.{i}") for i in range(rng.randrange(1, 8))] for b in range(4)]
    want: dict = {}
    table = spark.createDataFrame([], ROW)
    for b in batches:
        newest: dict = {}
        for k, o, v in b:
            if k not in newest or (o is not None, o or 0, v) > (newest[k][0] is not None, newest[k][0] or 0, newest[k][1]):
                newest[k] = (o, v)
        for k, (o, v) in newest.items():
            if k not in want or _wins(o, want[k][0]):
                want[k] = (o, v)
        next_rows = upsert.last_writer_wins(table, spark.createDataFrame(b, ROW), ["k"], "o", ["v"]).collect()
        table = spark.createDataFrame([tuple(r) for r in next_rows], ROW)
    assert rows(table) == sorted(((k, o, v) for k, (o, v) in want.items()), key=repr)


def test_children(spark):
    kids = "p string, c string"
    old, new, parents = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], kids), spark.createDataFrame([("a", "2"), ("a", "3"), ("a", "3")], kids), spark.createDataFrame([("a",), ("z",)], "p string")
    assert rows(upsert.replace_children(old, new, parents, ["p"], ["p", "c"])) == [("a", "2"), ("a", "3"), ("b", "1")]
    assert rows(upsert.child_rows_to_delete(old, new, parents, ["p"], ["p", "c"])) == [("a", "1")]


def test_merge_actions(spark):
    old = spark.createDataFrame([("same", 1, "x"), ("null", 1, None), ("diff", 1, "x"), ("gone", 1, "x"), ("far", 50, "x"), ("tech", 1, "x")], ROW)
    new = spark.createDataFrame([("same", 1, "x"), ("null", 1, None), ("diff", 1, "y"), ("new", 1, "n"), ("new", 1, "m"), ("tech", 2, "x")], ROW)
    actions = upsert.merge_actions(old, new, ["k"], ignore=("o",), scope=F.col("o") < 10)
    got = {r["k"]: (r["action"], r["o"], r["v"]) for r in actions.collect()}
    assert got == {"same": ("keep", 1, "x"), "null": ("keep", 1, None), "diff": ("update", 1, "y"), "new": ("insert", 1, "n"), "gone": ("delete", 1, "x"), "far": ("keep", 50, "x"), "tech": ("keep", 1, "x")}
    assert upsert.apply_actions(actions).count() == 6


def test_differences_and_pending(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(upsert.differences(a, b)) == [(1, "left"), (2, "left"), (3, "right")]
    assert rows(upsert.pending(a.distinct(), b, ["k"])) == [(2,)]


def test_snapshot_table(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert not table.exists()
    for k in range(4):
        table.upsert(spark.createDataFrame([(k, "v")], "k int, v string"), lambda now, new: upsert.insert_only(now, new, ["k"]))
    assert table.version() == 4 and rows(table.read()) == [(k, "v") for k in range(4)]
    with pytest.raises(Exception):
        table.upsert(spark.createDataFrame([(9, "v")], "k int, v string"), lambda now, new: new.select(F.raise_error(F.lit("no"))))
    assert table.version() == 4 and table.read().count() == 4
