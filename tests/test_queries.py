"""Every registered query of the engine against its SQL, and the entry point."""

from datetime import datetime
from itertools import permutations

import pytest
from oracle import differences, tables

import __spark_entry__ as entry
from amalgam.plans.registry import COVERS, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(spark, QUERIES[name], ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_says_what_it_covers():
    assert all(COVERS.values())


def test_recent_news_cents(spark, tmp_path):
    """Cents are rounded as in the SQL, and don't depend on the order in which days are added."""
    halves = [1.005, 2.675, 8.345, 49.555, 1.115, 0.125]
    days = list(permutations((1e16, 1.0, -1e16)))
    spark.createDataFrame([(i, f"c{i}") for i in range(12)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(i, 20, v) for i, v in enumerate(halves)] + [(6 + i, 20 + k, v) for i, p in enumerate(days) for k, v in enumerate(p)]
    events = [(n, datetime(2024, 1, day), user, "view", v) for n, (user, day, v) in enumerate(events)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["name"]: r["tone"] for r in QUERIES["recent_news"](spark, str(tmp_path)).collect()}
    want = {r[0]: r[3] for r in tables(str(tmp_path)).execute(ORACLES["recent_news"]).fetchall()}
    assert {n: got[n] for n in got if int(n[1:]) < 6} == {n: want[n] for n in want if int(n[1:]) < 6}
    assert [got[f"c{i}"] for i in range(6, 12)] == [0.33] * 6
