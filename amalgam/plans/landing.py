"""What sources and sinks do to rows, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.selection import latest
from ..sources.changes import change_range, columns_like, since_mark
from ..sources.landing import ingest_date, lines, sorted_json
from .merges import CUT, ntz
from .registry import query


@query("S02 S03 S05 F17", r"""
WITH f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, sha256(coalesce(text, '')) AS sha FROM documents),
x AS (SELECT doc_id, sha, unnest(range(len(l))) AS line, l FROM f)
SELECT doc_id, substr(sha, 1, 12) AS sha, line::INT AS line, l[line + 1] AS payload, DATE '2026-01-05' AS ingest_date FROM x WHERE regexp_replace(l[line + 1], '\s', '', 'g') <> ''""")
def line_split(t):
    path = F.concat(F.lit("src/ingest_date=2026-01-05/src_"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    files = t.documents.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    doc = F.regexp_extract("path", r"src_(\d+)\.jsonl$", 1).cast("long")
    return lines(files).select(doc.alias("doc_id"), F.substring("sha256", 1, 12).alias("sha"), "line", "payload", "ingest_date")


@query("S05", "SELECT event_id, CAST(ts AS DATE) AS ingest_date FROM events")
def partition_dates(t):
    path = F.concat(F.lit("landing/src/ingest_date="), F.date_format("ts", "yyyy-MM-dd"), F.lit("/x.jsonl"))
    return t.events.select("event_id", ingest_date(path).alias("ingest_date"))


@query("S07 T07", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update_before' ELSE 'update' END AS op FROM events
WHERE event_id > 100""")
def change_log_range(t):
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    log = t.events.select("event_id", F.concat(F.lit("0x"), F.lpad(F.hex("event_id"), 20, "0")).alias("lsn"), code.alias("op_code"))
    return change_range(log, f"0x{100:020X}").select("event_id", "op")


@query("S08 S11 S12 T09", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')")
def resume_after(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return since_mark(rows, rows.filter(F.col("o_orderdate") < ntz(CUT)), "o_orderdate")


@query("S14", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def key_columns(t):
    return columns_like(t.lineitem, "l_.*key")


@query("K15", """SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","none":null}' AS value FROM customer""")
def sorted_lines(t):
    return sorted_json(t.customer.select("c_name", "c_mktsegment", "c_custkey", F.lit(None).cast("string").alias("none")))


@query("T11 J06", f"""
WITH before AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' AND o_totalprice > 400000), after AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)
SELECT c_custkey, c_custkey IN (SELECT * FROM after) AS in_universe FROM customer WHERE (c_custkey IN (SELECT * FROM after)) <> (c_custkey IN (SELECT * FROM before))""")
def changed_flags(t):
    large = t.orders.filter("o_totalprice > 400000")
    flag = lambda df, name: df.select(F.col("o_custkey").alias(f"k_{name}")).distinct()
    before, after = flag(large.filter(F.col("o_orderdate") < ntz(CUT)), "before"), flag(large, "after")
    joined = t.customer.join(before, F.col("c_custkey") == F.col("k_before"), "left").join(after, F.col("c_custkey") == F.col("k_after"), "left")
    was, now = F.col("k_before").isNotNull(), F.col("k_after").isNotNull()
    return joined.filter(was != now).select("c_custkey", now.alias("in_universe"))


@query("W03", """
SELECT c_mktsegment, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_batch_per_source(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderkey", "o_orderdate")
    return latest(joined, ["c_mktsegment"], [F.desc("o_orderdate"), F.col("o_orderkey")])
