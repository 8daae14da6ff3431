"""Aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.statistics import fingerprint, weighted_mean
from ..operators.quality import freshness_state
from ..operators.selection import changes_of, latest, moving, stratified_quota, stratified_split, top, unpivot_attributes
from .registry import Tables, query

cents = lambda c: F.col(c).cast("decimal(18,2)")  # noqa: E731  exact sums of amounts


def day(column: str = "ts"):
    return F.to_date(column)


DAILY = """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS mentions, count(DISTINCT event_type) AS kinds,
       round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors
FROM events GROUP BY 1, 2"""


def daily(t: Tables):
    return t.events.groupBy("user_id", day().alias("day")).agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("event_type").alias("kinds"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"),
    )


@query("A01 A02 F05 G04", DAILY)
def daily_signal(t):
    return daily(t)


@query("W04 G07", f"""
WITH d AS ({DAILY})
SELECT user_id, day, mentions, mean_value,
       round(avg(mentions) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mentions_ma7 FROM d""")
def daily_signal_ma7(t):
    d = moving(daily(t), "mentions", ["user_id"], ["day"], 7, "ma")
    return d.select("user_id", "day", "mentions", "mean_value", F.round("ma", 6).alias("mentions_ma7"))


@query("A03 G36", """
SELECT user_id, round(sum(value * mentions) / nullif(sum(mentions), 0), 6) AS weighted, sum(mentions)::BIGINT AS mentions
FROM (SELECT user_id, event_type, avg(value) AS value, count(*) AS mentions FROM events GROUP BY 1, 2) GROUP BY user_id ORDER BY weighted, user_id""")
def weighted_tone(t):
    kinds = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("mentions"))
    return kinds.groupBy("user_id").agg(F.round(weighted_mean(F.col("value"), F.col("mentions")), 6).alias("weighted"), F.sum("mentions").alias("mentions")).orderBy("weighted", "user_id")


@query("W01 W02 W03 G28", """
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_node(t):
    return latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


@query("W02 A04 G29", """
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type, count(*) AS nodes, count_if(value >= 50)::BIGINT AS passing, count_if(value < 50)::BIGINT AS failing, max(ts) AS last_run FROM l GROUP BY event_type""")
def outcome_summary(t):
    last = latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("value") >= 50).alias("passing"), F.count_if(F.col("value") < 50).alias("failing"), F.max("ts").alias("last_run")
    )


@query("W05 F01 G37", """
WITH v AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS after FROM events),
     w AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM v)
SELECT user_id, event_id, before, after FROM w WHERE before <> after""")
def lag_changes(t):
    return changes_of(t.events, F.get_json_object("props", "$.k"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "before", "after")


@query("O01 O02", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 500")
def topk_recent(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(500)


@query("O03", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 5""")
def top5_per_key(t):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    return top(t.lineitem, ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.row_number().over(w).alias("rank"))


@query("W04 A21", """
SELECT event_type, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def kinds_by_day(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct(day()).alias("days"), F.countDistinct("user_id").alias("users"))


@query("A04 A09 G18", """
SELECT count(*) AS customers, count_if(c_acctbal < 0)::BIGINT AS in_debt, count(DISTINCT c_nationkey) AS nations, bool_or(c_acctbal > 9000) AS any_rich,
       (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders) AS further_orders FROM customer""")
def panorama_counts(t):
    further = t.orders.agg((F.count(F.lit(1)) - F.countDistinct("o_custkey")).alias("further_orders"))
    return t.customer.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.countDistinct("c_nationkey").alias("nations"), F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich")
    ).crossJoin(F.broadcast(further))  # both are one row


@query("A11 A20 G19 G30 G31", """
SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL""")
def band_histogram(t):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return t.customer.groupBy(band.alias("band"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("A05 A06 A07 F09 F10", """
SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS priorities,
       list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'F')) AS filled, min(o_orderpriority) AS first_priority FROM orders GROUP BY o_custkey""")
def collected_sets(t):
    return t.orders.groupBy("o_custkey").agg(
        F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"),
        F.nullif(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))), F.array().cast("array<bigint>")).alias("filled"),
        F.min("o_orderpriority").alias("first_priority"),
    )


@query("A08", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1 HAVING count(*) > 12 AND count(DISTINCT o_orderpriority) > 4")
def having_several(t):
    grouped = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("priorities"))
    return grouped.filter("n > 12 AND priorities > 4")


@query("A10", "SELECT DISTINCT p_name, p_brand FROM part")
def distinct_pairs(t):
    return t.part.select("p_name", "p_brand").distinct()


@query("A12 T08 U01", """
WITH seen AS (SELECT 'events' AS source, max(ts) AS last, 12.0 AS warn, 48.0 AS error FROM events
              UNION ALL SELECT 'orders', max(o_orderdate), 240, 720 FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate), 36, 72 FROM lineitem),
aged AS (SELECT *, (epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(date_trunc('second', last))) / 3600.0 AS hours FROM seen)
SELECT source, last, round(hours, 3) AS hours, CASE WHEN hours IS NULL OR hours > error THEN 'error' WHEN hours > warn THEN 'warn' ELSE 'ok' END AS state FROM aged""")
def freshness_status(t):
    source = lambda name, df, column, warn, error: df.agg(F.max(column).alias("last")).select(F.lit(name).alias("source"), "last", F.lit(warn).alias("warn"), F.lit(error).alias("error"))
    seen = source("events", t.events, "ts", 12.0, 48.0).unionByName(source("orders", t.orders, "o_orderdate", 240.0, 720.0)).unionByName(source("lineitem", t.lineitem, "l_shipdate", 36.0, 72.0))
    hours = (F.unix_timestamp(F.lit("2024-01-31 06:00:00").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 3600.0
    aged = seen.withColumn("hours", hours)
    return aged.select("source", "last", F.round("hours", 3).alias("hours"), freshness_state(F.col("hours"), F.col("warn"), F.col("error")).alias("state"))


@query("F06 J15", """
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
     newest AS (SELECT max(o_orderdate) AS newest FROM orders)
SELECT o_orderkey, CAST((epoch(first_ship) - epoch(o_orderdate)) / 60 AS DOUBLE) AS minutes_to_ship, round((epoch(newest) - epoch(o_orderdate)) / 3600.0, 1) AS hours_before_newest
FROM orders JOIN s ON o_orderkey = l_orderkey CROSS JOIN newest""")
def latency_minutes(t):
    ship = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    newest = t.orders.agg(F.max("o_orderdate").alias("newest"))
    at = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    joined = t.orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(newest))  # newest is one row
    return joined.select("o_orderkey", ((at("first_ship") - at("o_orderdate")) / 60).alias("minutes_to_ship"), F.round((at("newest") - at("o_orderdate")) / 3600.0, 1).alias("hours_before_newest"))


@query("P11 F06 F07", """
SELECT c_mktsegment, count_if(o_orderdate >= DATE '2001-08-01' - 30)::BIGINT AS last_30, count_if(o_orderdate >= DATE '2001-08-01' - 90)::BIGINT AS last_90,
       date_trunc('month', max(o_orderdate)) AS last_month FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def recent_windows(t):
    now = F.lit("2001-08-01").cast("date")
    since = lambda n: F.count_if(F.col("o_orderdate") >= F.date_sub(now, n))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(since(30).alias("last_30"), since(90).alias("last_90"), F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("last_month"))


@query("U02 U03", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("U04 U05", """
(SELECT 'left' AS side, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT 'left', c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0)
UNION ALL (SELECT 'right', c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0 EXCEPT SELECT 'right', c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000)""")
def except_both_ways(t):
    pairs = lambda c: t.customer.filter(c).select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    a, b = pairs("c_acctbal > 9000"), pairs("c_acctbal < 0")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query("P14 F13 G10", """
SELECT c_custkey, position, attribute, value FROM (
  SELECT c_custkey, 1 AS position, 'name' AS attribute, c_name AS value FROM customer UNION ALL SELECT c_custkey, 2, 'nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 3, 'segment', c_mktsegment FROM customer)""")
def ficha_unpivot(t):
    return unpivot_attributes(t.customer, ["c_custkey"], {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")})


@query("X22 X23", """
WITH s AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels WINDOW w AS (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR)))
SELECT doc_id, quality, toxic, CASE WHEN r * 2 <= n + 1 THEN 'calibration' ELSE 'evaluation' END AS part FROM s""")
def stratified_halves(t):
    return stratified_split(t.labels, ["quality", "toxic"], F.md5(F.col("doc_id").cast("string")), "calibration", "evaluation")


@query("X23", "SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(doc_id::VARCHAR)) <= 15")
def stratified_sample(t):
    return stratified_quota(t.labels, ["quality", "toxic"], F.md5(F.col("doc_id").cast("string")), 15)


@query("A19")
def fingerprints(t):
    parts = [fingerprint(getattr(t, n)).withColumn("table", F.lit(n)) for n in ("nation", "customer", "orders", "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("S19 J15", "SELECT r_regionkey, w.weight, r_regionkey * w.weight AS weighted FROM region, (VALUES (1), (2), (5)) w(weight)")
def cross_product_params(t):
    weights = t.spark.sql("SELECT * FROM VALUES (1), (2), (5) AS w(weight)")
    return t.region.crossJoin(F.broadcast(weights)).select("r_regionkey", "weight", (F.col("r_regionkey") * F.col("weight")).alias("weighted"))
