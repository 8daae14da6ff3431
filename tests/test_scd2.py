"""Change history against a row-by-row model of its rules, on random logs cut into batches and replayed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from amalgam.operators import scd2

LOG = "k string, v string, modified_at string, op string, lsn string, seqval string, commit_time timestamp"
T0 = datetime(2026, 1, 1)


def model(changes):
    out = {}
    for k, v, _, op, lsn, seq, at in sorted(set(changes), key=lambda c: (c[4], c[5])):
        history = out.setdefault(k, [])
        open_row = history[-1] if history and history[-1][3] is None else None
        if op == "update_before" or (op == "delete" and not open_row):
            continue
        if op != "delete" and open_row and open_row[1] == v:
            continue
        if open_row:
            open_row[3] = at
        if op != "delete":
            history.append([k, v, at, None])
    return sorted((tuple(r) for h in out.values() for r in h), key=repr)


def random_log(seed, n=60):
    rng = random.Random(seed)
    ops = ["insert", "update", "update", "update_before", "delete"]
    return [(rng.choice("ABCD"), rng.choice(["x", "y", None]), f"t{i}", rng.choice(ops), f"0x{i // 2:020X}", f"0x{i % 2:020X}", T0 + timedelta(minutes=i)) for i in range(n)]


def rows(df):
    return sorted(((r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in df.collect()), key=repr)


def frame(spark, log):
    return spark.createDataFrame(log, LOG)


@pytest.mark.parametrize("seed", range(8))
def test_whole_log(spark, seed):
    log = random_log(seed)
    assert rows(scd2.versions(frame(spark, log + log[:5]), ["k"], ["v", "modified_at"])) == model(log)


@pytest.mark.parametrize("seed", range(6))
def test_batches_and_replays_give_the_same(spark, seed):
    log = random_log(seed, 40)
    a, b = sorted(random.Random(seed).sample(range(41), 2))
    stored = None
    for batch in (log[:a], log[:b], log[b:], log[a:], log):
        df = scd2.versions(frame(spark, batch), ["k"], ["v", "modified_at"], stored)
        stored = spark.createDataFrame(df.collect(), df.schema)
    assert rows(stored) == model(log)
    now = scd2.current(stored)
    assert now.columns == ["k", "v", "modified_at", "valid_from"]
    assert now.count() == sum(r[3] is None for r in model(log))


def test_null_differs_from_empty_text(spark):
    log = [("A", None, "t", "insert", "0x1", "0", T0), ("A", "", "t", "update", "0x2", "0", T0), ("A", "", "u", "update", "0x3", "0", T0)]
    assert scd2.versions(frame(spark, log), ["k"], ["v", "modified_at"]).count() == 2
    assert scd2.versions(frame(spark, []), ["k"], ["v", "modified_at"]).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("op", ["merge", "", None])
def test_an_unknown_operation_fails(spark, op):
    df = spark.createDataFrame([(1, "a", "insert", "01", 1, 1), (1, "b", op, "02", 1, 2)], "k int, v string, op string, lsn string, seqval int, commit_time int")
    with pytest.raises(Exception, match="unknown operation"):
        scd2.versions(df, ["k"], ["v"]).collect()
