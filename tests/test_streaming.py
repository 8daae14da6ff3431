import json
import os

import pytest

from amalgam.sources import landing
from amalgam.sources.changes import ChangeGap, ScanTooLarge, append_by_day, change_range, columns_like, guarded, since_mark, unseen, watch_list
from amalgam.storage import SnapshotTable
from amalgam.streaming import bronze


def land(spark, root, stamp, records, last=None):
    return landing.publish(spark, "src", records, root, stamp, "2026-01-02T00:00:00Z", last)


def approve(root, stamp, sha, state="approved", failures=()):
    with open(f"{root[7:]}/src/ingest_date={stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}/_verdict_{stamp}.json", "w") as f:
        json.dump({"state": state, "sha256": sha, "critical_failures": list(failures)}, f)


def test_ingest_in_micro_batches(spark, tmp_path):
    root, tables = f"file://{tmp_path}/landing", f"file://{tmp_path}/tables"
    first = land(spark, root, "20260101T000000", [{"id": 1}, {"id": 2}])
    with pytest.raises(Exception, match="no verdict yet"):
        bronze.ingest(spark, "src", root, tables)
    approve(root, "20260101T000000", first["sha256"])
    bronze.ingest(spark, "src", root, tables)  # the file that failed is delivered again
    beat = land(spark, root, "20260102T000000", [{"id": 1}, {"id": 2}], first)
    assert beat["heartbeat"] and beat["file"] is None and beat["last_file"] == first["file"]
    bad = land(spark, root, "20260103T000000", [{"id": 3}])
    approve(root, "20260103T000000", bad["sha256"], "quarantined", ["unique id"])
    third = land(spark, root, "20260104T000000", [{"id": 2}, {"id": 1}])
    approve(root, "20260104T000000", third["sha256"])
    same = land(spark, root, "20260105T000000", [{"id": 1}, {"id": 2}])
    approve(root, "20260105T000000", same["sha256"])
    bronze.ingest(spark, "src", root, tables)
    bronze.ingest(spark, "src", root, tables)  # nothing new
    log = {r["file"]: (r["state"], r["reason"]) for r in SnapshotTable(spark, f"{tables}/ingestion_log").read().collect()}
    assert log == {
        "src_20260101T000000.jsonl": ("ingested", None), "src_20260103T000000.jsonl": ("quarantined", "contract: unique id"), "src_20260104T000000.jsonl": ("ingested", None),
        "src_20260105T000000.jsonl": ("duplicate", "same content as src_20260101T000000.jsonl"),
    }
    raw = SnapshotTable(spark, f"{tables}/raw_src").read()
    assert raw.count() == 4 and {str(r["ingest_date"]) for r in raw.collect()} == {"2026-01-01", "2026-01-04"}
    assert landing.newest_manifest(spark, f"{root}/src") == "20260105T000000"
    ledger = bronze.ledger(spark, tables)
    for _ in range(2):
        bronze.mark_processed(ledger, spark.createDataFrame([("src", first["sha256"], 2)], "source string, sha256 string, n long"))
    assert ledger.read().count() == 1


FILE = "path string, sha256 string, n_lines long, manifest string, verdict string, manifest_sha256 string, records long, verdict_state string, verdict_sha256 string, critical_failures array<string>"


def test_classification(spark):
    files = [
        ("d/a.jsonl", "s1", 2, "m", "v", "s1", 2, "approved", "s1", None), ("d/b.jsonl", "s1", 2, "m", "v", "s1", 2, "approved", "s1", None),
        ("d/c.jsonl", "s2", 2, "m", "v", "xx", 2, "approved", "s2", None), ("d/d.jsonl", "s3", 2, "m", "v", "s3", 3, "approved", "s3", None),
        ("d/e.jsonl", "s4", 2, "m", "v", "s4", 2, "quarantined", "s4", ["x", "y"]), ("d/f.jsonl", "s5", 2, "m", "v", "s5", None, "approved", "s5", None),
        ("d/g.jsonl", "s6", 1, "m", "v", "s6", 1, "approved", "s6", None), ("d/h.jsonl", "s7", 1, "m", "v", "s7", 1, "approved", "s7", None),
    ]
    done = spark.createDataFrame([("s6", "old/z.jsonl"), ("s7", "d/h.jsonl")], "sha256 string, path string")
    got = {r["path"][2]: (r["state"], r["reason"]) for r in bronze.classify(spark.createDataFrame(files, FILE), done).collect()}
    assert got == {
        "a": ("ingested", None), "b": ("duplicate", "same content as a.jsonl"), "c": ("error", "hash differs from the manifest's"), "d": ("error", "2 lines, the manifest says 3"),
        "e": ("quarantined", "contract: x, y"), "f": ("ingested", None), "g": ("duplicate", "same content as z.jsonl"), "h": ("ingested", None),
    }


def test_readiness(spark):
    files = [("a", "s", 1, None, None, None, None, None, None, None), ("b", "s", 1, "m", None, "s", 1, None, None, None), ("c", "s", 1, "m", "v", "s", 1, "approved", "old", None), ("d", "s", 1, "m", "v", "s", 1, "approved", "s", None)]
    got = {r["path"]: r["waits_for"] for r in bronze.readiness(spark.createDataFrame(files, FILE)).collect()}
    assert got == {"a": "no manifest yet", "b": "no verdict yet", "c": "the verdict is on other content"}


def test_lines_keep_their_numbers(spark, tmp_path):
    os.makedirs(tmp_path / "ingest_date=2026-02-03")
    (tmp_path / "ingest_date=2026-02-03" / "x_1.jsonl").write_bytes(b'{"a":1}\n\n  \n{"a":2}\n')
    batch = landing.files(spark, f"file://{tmp_path}")
    assert [(r["line"], r["payload"], str(r["ingest_date"])) for r in landing.lines(batch).orderBy("line").collect()] == [(0, '{"a":1}', "2026-02-03"), (3, '{"a":2}', "2026-02-03")]
    assert landing.describe_files(batch).first()["n_lines"] == 2


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert landing.content_hash(a) == landing.content_hash(a.orderBy("v")) != landing.content_hash(a.limit(1))


def test_change_range(spark):
    log = spark.createDataFrame([(f"0x{i:020X}", i % 4 + 1) for i in range(5, 12)], "lsn string, op_code int")
    got = change_range(log, f"0x{6:020X}", f"0x{9:020X}").orderBy("lsn").collect()
    assert [(int(r["lsn"], 16), r["op"]) for r in got] == [(7, "update"), (8, "delete"), (9, "insert")]
    assert change_range(log, f"0x{4:020X}").count() == 7
    with pytest.raises(ChangeGap):
        change_range(log, f"0x{2:020X}")


def test_marks_windows_and_guards(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "m int, k string")
    assert since_mark(a, a.filter("m <= 2"), "m").count() == 2 and since_mark(a, a.filter("false"), "m").count() == 4
    assert sorted(r["k"] for r in unseen(a, a.filter("m = 1"), ["k"]).collect()) == ["b", "c"]
    append_by_day(a.withColumnRenamed("m", "day"), f"file://{tmp_path}/arch", "day")
    whole = spark.read.parquet(f"file://{tmp_path}/arch")
    assert guarded(whole, 10**9).count() == 4
    with pytest.raises(ScanTooLarge):
        guarded(whole, 1)
    assert columns_like(spark.createDataFrame([(1, 2, 3)], "x_1 int, x_2 int, y int"), "x_.*").columns == ["x_1", "x_2"]


def test_watch_list(spark, tmp_path):
    (tmp_path / "w.csv").write_text('id,schema,name,countries,identifiers,last_seen\n1,Company,A,ar;us,x,z\n2,Person,B,ar,x,z\n3,Company,C,us,"k 20S05OYHG0MQM4VUIC57;q",z\n4,Company,D,us,,z\n')
    got = watch_list(spark, f"file://{tmp_path}/w.csv", "ar", "[0-9A-Z]{18}[0-9]{2}", ["countries"], ["last_seen"]).orderBy("id").collect()
    assert [(r["id"], r["countries"], r["ids"]) for r in got] == [("1", ["ar", "us"], []), ("3", ["us"], ["20S05OYHG0MQM4VUIC57"])]
    assert "last_seen" not in got[0].asDict()
