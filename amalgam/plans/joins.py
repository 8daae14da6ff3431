"""Joins, filters and the consumption queries made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import component_of, inner_edges, neighbours
from .facts import cents
from .registry import query

SPENT = "SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count_if(o_orderstatus = 'F')::BIGINT AS filled FROM orders GROUP BY 1"


@query("J05 A04 P12 F16 G06", f"""
WITH o AS ({SPENT}), l AS (SELECT o_custkey, count(DISTINCT l_partkey) AS parts, CAST(sum(CAST(l_discount AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / nullif(sum(l_quantity), 0) AS discount
                           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(orders, 0) AS orders, coalesce(spent, 0) AS spent, coalesce(filled, 0) AS filled, coalesce(parts, 0) AS parts, discount,
       CASE WHEN orders IS NULL THEN 'none' ELSE 'active' END AS activity
FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def company_mart(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).cast("double").alias("spent"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k2")).agg(
        F.countDistinct("l_partkey").alias("parts"), (F.sum(cents("l_discount") * cents("l_quantity")).cast("double") / F.nullif(F.sum("l_quantity"), F.lit(0))).alias("discount")
    )
    joined = t.customer.join(o, F.col("c_custkey") == F.col("k"), "left").join(lines, F.col("c_custkey") == F.col("k2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("c_custkey", "c_name", zero("orders"), zero("spent"), zero("filled"), zero("parts"), "discount", F.when(F.col("orders").isNull(), "none").otherwise("active").alias("activity"))


@query("J01 J02 G01 G02", """
SELECT c_custkey AS key, n_name AS nation, r_name AS region, c_custkey = first AS is_anchor FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT c_nationkey AS k, min(c_custkey) AS first FROM customer GROUP BY 1) ON k = c_nationkey""")
def bridge_star(t):
    first = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("first"))
    star = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return star.join(first, F.col("k") == F.col("c_nationkey")).select(F.col("c_custkey").alias("key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), (F.col("c_custkey") == F.col("first")).alias("is_anchor"))


@query("J03 J04 J06 U01 F01 G03", """
WITH facts AS (SELECT 'customer:' || o_custkey AS key, 'order' AS kind, to_json({'id': o_orderkey}) AS detail, o_orderdate AS changed_at FROM orders
               UNION ALL SELECT 'supplier:' || l_suppkey, 'line', to_json({'id': l_orderkey}), l_shipdate FROM lineitem)
SELECT key, kind, detail::VARCHAR AS detail, changed_at, c_name AS name, c_name IS NULL AS unknown FROM facts LEFT JOIN customer ON key = 'customer:' || c_custkey""")
def history_left(t):
    fact = lambda df, prefix, key, kind, ident, at: df.select(F.concat(F.lit(prefix), F.col(key)).alias("key"), F.lit(kind).alias("kind"), F.to_json(F.struct(F.col(ident).alias("id"))).alias("detail"), F.col(at).alias("changed_at"))
    facts = fact(t.orders, "customer:", "o_custkey", "order", "o_orderkey", "o_orderdate").unionByName(fact(t.lineitem, "supplier:", "l_suppkey", "line", "l_orderkey", "l_shipdate"))
    names = t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("k"), F.col("c_name").alias("name"))
    return facts.join(names, F.col("key") == F.col("k"), "left").select("key", "kind", "detail", "changed_at", "name", F.col("name").isNull().alias("unknown"))


@query("J07 J08 J09", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus IN ('F', 'O'))")
def child_anti(t):
    done = t.orders.filter(F.col("o_orderstatus").isin("F", "O"))
    return t.lineitem.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("J10", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def child_semi(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return t.lineitem.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("J18 T12", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def not_in_window(t):
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_custkey")
    return t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("J19 U03 P09 G34", """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT n_nationkey FROM nation WHERE n_name ILIKE '%ION_1%') AND c_name ILIKE '%customer#%7%'""")
def semi_union(t):
    nations = t.supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n")).union(t.nation.filter(F.col("n_name").ilike("%ION_1%")).select("n_nationkey")).distinct()
    return t.customer.filter(F.col("c_name").ilike("%customer#%7%")).join(nations, F.col("c_nationkey") == F.col("n"), "left_semi").select("c_custkey", "c_name")


@query("J20 G11", """
SELECT c_custkey, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey) AS spent, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer""")
def scalar_subqueries(t):
    t.customer.createOrReplaceTempView("__customer")
    t.orders.createOrReplaceTempView("__orders")
    return t.spark.sql("""
        SELECT c_custkey, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM __orders WHERE o_custkey = c_custkey) AS spent,
               (SELECT count(*) FROM __orders WHERE o_custkey = c_custkey) AS orders FROM __customer""")


@query("J12 J13 P05", """
WITH p AS (SELECT DISTINCT a.l_suppkey AS sa, b.l_suppkey AS sb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)
SELECT sa, sb, x.s_name AS name_a, y.s_name AS name_b, nx.n_name AS nation_a, ny.n_name AS nation_b FROM p JOIN supplier x ON sa = x.s_suppkey JOIN supplier y ON sb = y.s_suppkey
JOIN nation nx ON x.s_nationkey = nx.n_nationkey JOIN nation ny ON y.s_nationkey = ny.n_nationkey""")
def pair_lookup(t):
    first, second = t.lineitem.filter("l_linenumber = 1").alias("a"), t.lineitem.filter("l_linenumber = 2").alias("b")
    pairs = first.join(second, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey"))).select(F.col("a.l_suppkey").alias("sa"), F.col("b.l_suppkey").alias("sb")).distinct()
    side = lambda s: t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias(f"k{s}"), F.col("s_name").alias(f"name_{s}"), F.col("n_name").alias(f"nation_{s}"))
    return pairs.join(side("a"), F.col("sa") == F.col("ka")).join(side("b"), F.col("sb") == F.col("kb")).select("sa", "sb", "name_a", "name_b", "nation_a", "nation_b")


@query("P06", """
SELECT a.k AS k, n_a, n_b FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n_a FROM customer GROUP BY 1) a
JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n_b FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_keys(t):
    a = t.customer.groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("n_a"))
    b = t.supplier.groupBy(F.nullif("s_nationkey", F.lit(3)).alias("k2")).agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, a["k"].eqNullSafe(b["k2"])).select("k", "n_a", "n_b")


@query("P07 P10 J11", """
WITH ids AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1)
SELECT c_custkey, c_nationkey = 7 AS home, coalesce(list_contains(statuses, 'P'), false) AS partial FROM customer LEFT JOIN ids ON c_custkey = o_custkey
WHERE c_nationkey = 7 OR coalesce(list_contains(statuses, 'P'), false)""")
def universe(t):
    ids = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    partial = F.coalesce(F.array_contains("statuses", "P"), F.lit(False))
    return t.customer.join(ids, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.col("c_nationkey") == 7).alias("home"), partial.alias("partial")).filter("home OR partial")


@query("J02 G05 G08 F10", """
WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses, count_if(o_orderpriority = '1-URGENT')::BIGINT AS urgent FROM orders GROUP BY 1)
SELECT c_custkey, n_name AS nation, array_to_string(statuses, ', ') AS statuses, CASE WHEN urgent > 3 THEN 'alert' ELSE 'watch' END AS level, coalesce(list_contains(statuses, 'F'), false) AS by_id
FROM customer JOIN s ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0""")
def risk_mart(t):
    s = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    joined = t.customer.filter("c_acctbal < 0").join(s, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", F.col("n_name").alias("nation"), F.array_join("s", ", ").alias("statuses"), F.when(F.col("urgent") > 3, "alert").otherwise("watch").alias("level"), F.coalesce(F.array_contains("s", "F"), F.lit(False)).alias("by_id"))


@query("P01 P08 F14", """
SELECT concat(c_name, ' · ', c_custkey) AS label, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'creditor' END AS role, r_name AS region, format('{:,.3f}', c_acctbal) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY c_acctbal DESC, label""")
def region_card(t):
    star = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    star.createOrReplaceTempView("__star")
    return t.spark.sql("""
        SELECT concat(c_name, ' · ', c_custkey) AS label, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'creditor' END AS role, r_name AS region, format_number(c_acctbal, 3) AS balance
        FROM __star WHERE r_name = :region ORDER BY c_acctbal DESC, label""", args={"region": "ASIA"})


@query("J27", """
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45),
     s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')
SELECT DISTINCT b AS k FROM e JOIN s ON a = k WHERE b NOT IN (SELECT k FROM s) UNION SELECT DISTINCT a FROM e JOIN s ON b = k WHERE a NOT IN (SELECT k FROM s)""")
def reach_neighbours(t):
    edges = t.lineitem.filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    seeds = t.lineitem.filter("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return neighbours(edges, seeds, "a", "b", "k")


@query("J26", """
WITH m AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0), e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)
SELECT (a IN (SELECT k FROM m))::INT + (b IN (SELECT k FROM m))::INT AS ends, count(*) AS edges FROM e GROUP BY 1""")
def membership_ends(t):
    members = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return inner_edges(edges, members, "a", "b", "k").groupBy("ends").agg(F.count(F.lit(1)).alias("edges"))


@query("X18 X19", """
WITH RECURSIVE e AS (SELECT DISTINCT a.c_custkey AS x, b.s_suppkey + 1000000000 AS y FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND floor(a.c_acctbal / 100) = floor(b.s_acctbal / 100)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e), nodes AS (SELECT DISTINCT x AS node FROM both_ways),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def connected_nodes(t):
    bucket = lambda c: F.floor(F.col(c) / 100)
    pairs = t.customer.join(t.supplier, (F.col("c_nationkey") == F.col("s_nationkey")) & (bucket("c_acctbal") == bucket("s_acctbal"))).select(F.col("c_custkey").alias("x"), (F.col("s_suppkey") + 1000000000).alias("y"))
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    return component_of(nodes, pairs, "node", "x", "y")
