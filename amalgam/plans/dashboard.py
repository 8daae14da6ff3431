"""What dashboards ask of the tables, one query each. Customers stand for entities, their orders for the source records that
were resolved to them, order lines for entries of risk lists, events for news, parts and suppliers for the ends of a pair."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.statistics import round_product, steady_sum
from ..operators.selection import latest
from ..storage import shared_dir
from .registry import Tables, query

#: The label that a reader of the dashboard has chosen; the key is at its end.
LABEL = "Customer · 7"
KEY_OF_LABEL = "CAST(regexp_extract(:label, '([0-9]+)$', 1) AS BIGINT)"


def asked(t: Tables, sql: str, **views):
    """Parameterised SQL over views."""
    for name, df in views.items():
        df.createOrReplaceTempView(f"__dash_{name}")
    return t.spark.sql(sql, args={"label": LABEL})


@query("G09", "SELECT concat(c_name, ' · ', c_custkey) AS label, c_name AS name, n_name AS country, count(o_orderkey) AS records FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, n_name")
def entity_search(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("records"))
    found = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return found.select(F.concat("c_name", F.lit(" · "), "c_custkey").alias("label"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.coalesce("records", F.lit(0)).alias("records"))


@query("G12 P08", """
SELECT o_orderstatus AS source, o_orderkey AS source_id, CASE WHEN o_orderkey = min(o_orderkey) OVER () THEN 'anchor' ELSE '' END AS role, o_orderdate AS recorded
FROM orders WHERE o_custkey = CAST(regexp_extract('Customer · 7', '([0-9]+)$', 1) AS BIGINT) ORDER BY role DESC, source, source_id""")
def entity_sources(t):
    anchors = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("anchor")).withColumnRenamed("o_custkey", "of")
    bridge = t.orders.join(anchors, F.col("o_custkey") == F.col("of"))
    return asked(t, f"""
        SELECT o_orderstatus AS source, o_orderkey AS source_id, CASE WHEN o_orderkey = anchor THEN 'anchor' ELSE '' END AS role, o_orderdate AS recorded
        FROM __dash_bridge WHERE o_custkey = {KEY_OF_LABEL} ORDER BY role DESC, source, source_id""", bridge=bridge)


#: Pairs of a part and a supplier, decided by the quantity of their largest line.
PAIRS = """pairs AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity)::INT AS score, CASE WHEN max(l_quantity) >= 45 THEN 'deterministic' WHEN max(l_quantity) >= 25 THEN 'accepted' ELSE 'review' END AS decision
FROM lineitem GROUP BY 1, 2)"""


def decided_pairs(t: Tables):
    most = F.max("l_quantity")
    return t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(
        most.cast("int").alias("score"), F.when(most >= 45, "deterministic").when(most >= 25, "accepted").otherwise("review").alias("decision")
    )


@query("G13 J12", f"""
WITH {PAIRS} SELECT a, pa.p_name AS name_a, b, pb.p_name AS name_b, decision, score, concat('{{"quantity":', score, ',"size":', pa.p_size, '}}') AS points
FROM pairs JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b JOIN supplier sa ON sa.s_suppkey = a JOIN supplier sb ON sb.s_suppkey = b
WHERE sa.s_nationkey = 7 AND sb.s_nationkey = 7 AND decision IN ('deterministic', 'accepted')""")
def resolved_pairs(t):
    """Both ends are looked up twice: their entity (the nation of the supplier of that number) and their record (the part)."""
    entity = lambda s: t.supplier.filter("s_nationkey = 7").select(F.col("s_suppkey").alias(s))
    record = lambda s: t.part.select(F.col("p_partkey").alias(s), F.col("p_name").alias(f"name_{s}"), F.col("p_size").alias(f"size_{s}"))
    taken = decided_pairs(t).filter(F.col("decision").isin("deterministic", "accepted")).join(entity("a"), "a").join(entity("b"), "b")
    points = F.to_json(F.create_map(F.lit("quantity"), F.col("score"), F.lit("size"), F.col("size_a")))
    return taken.join(record("a"), "a").join(record("b"), "b").select("a", "name_a", "b", "name_b", "decision", "score", points.alias("points")).orderBy(F.desc("decision"), F.desc("score"))


@query("G14", f"""
WITH {PAIRS} SELECT a, pa.p_name AS name_a, b, pb.p_name AS name_b, score FROM pairs JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b
JOIN supplier sa ON sa.s_suppkey = a JOIN supplier sb ON sb.s_suppkey = b WHERE decision = 'review' AND 7 IN (sa.s_nationkey, sb.s_nationkey)""")
def review_of_entity(t):
    return asked(t, f"""
        SELECT p.a, pa.p_name AS name_a, p.b, pb.p_name AS name_b, p.score FROM __dash_pairs p JOIN __dash_part pa ON pa.p_partkey = p.a JOIN __dash_part pb ON pb.p_partkey = p.b
        JOIN __dash_supplier sa ON sa.s_suppkey = p.a JOIN __dash_supplier sb ON sb.s_suppkey = p.b
        WHERE p.decision = 'review' AND {KEY_OF_LABEL} IN (sa.s_nationkey, sb.s_nationkey) ORDER BY p.score DESC""", pairs=decided_pairs(t), part=t.part, supplier=t.supplier)


CHANGES = """changes AS (SELECT user_id, ts AS valid_from, lead(ts) OVER w AS valid_to, event_type AS operation, props AS detail, event_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def entity_versions(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), F.col("event_type").alias("operation"), F.col("props").alias("detail"), "event_id")


@query("G15", f"WITH {CHANGES} SELECT valid_from, operation, CASE WHEN valid_to IS NULL THEN 'current' ELSE 'historic' END AS version, valid_to, detail FROM changes WHERE user_id = 7")
def entity_changes(t):
    return asked(t, f"""
        SELECT valid_from, operation, CASE WHEN valid_to IS NULL THEN 'current' ELSE 'historic' END AS version, valid_to, detail FROM __dash_changes
        WHERE user_id = {KEY_OF_LABEL} ORDER BY valid_from DESC, operation""", changes=entity_versions(t))


NEWS = """news AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS mentions, count(DISTINCT event_type) AS media, avg(value) AS tone, count_if(value < 20)::BIGINT AS negative
FROM events GROUP BY 1, 2)"""


def news(t: Tables):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("event_type").alias("media"), F.avg("value").alias("tone"), F.count_if(F.col("value") < 20).alias("negative")
    )


@query("G16", f"WITH {NEWS} SELECT day, mentions, media, round(tone, 6) AS tone, negative FROM news WHERE user_id = 7")
def entity_news(t):
    return asked(t, f"SELECT day, mentions, media, round(tone, 6) AS tone, negative FROM __dash_news WHERE user_id = {KEY_OF_LABEL}", news=news(t))


FLAGS = """flags AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS lists, list_sort(list(DISTINCT l_linestatus)) AS countries, bool_or(l_returnflag = 'R') AS sanctioned,
bool_or(l_linenumber = 1) AS by_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_change FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_FLAG = "CASE WHEN sanctioned THEN 'yes' ELSE 'no' END AS sanctioned, array_to_string(lists, ', ') AS lists"


def risk_flags(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("lists"), F.array_sort(F.collect_set("l_linestatus")).alias("countries"), F.bool_or(F.col("l_returnflag") == "R").alias("sanctioned"),
        F.bool_or(F.col("l_linenumber") == 1).alias("by_id"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_change"),
    )
    return t.orders.select("o_custkey", "o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))


def flag_columns():
    return F.when(F.col("sanctioned"), "yes").otherwise("no").alias("sanctioned"), F.array_join("lists", ", ").alias("lists")


@query("G17", f"WITH {FLAGS} SELECT o_orderkey, {_FLAG}, array_to_string(countries, ', ') AS countries, CASE WHEN by_id THEN 'LEI' ELSE 'name' END AS link, first_seen, last_change FROM flags WHERE o_custkey = 7")
def entity_risk(t):
    mine = asked(t, f"SELECT * FROM __dash_flags WHERE o_custkey = {KEY_OF_LABEL}", flags=risk_flags(t))
    return mine.select("o_orderkey", *flag_columns(), F.array_join("countries", ", ").alias("countries"), F.when(F.col("by_id"), "LEI").otherwise("name").alias("link"), "first_seen", "last_change")


@query("G20", """
SELECT c_name AS name, count(*) AS records, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ', ') AS sources, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name HAVING count(*) > 1""")
def most_consolidated(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("records"), F.array_sort(F.collect_set("o_orderstatus")).alias("found")).filter("records > 1")
    named = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("records"), F.desc(F.size("found")), "c_name")
    return named.select(F.col("c_name").alias("name"), "records", F.array_join("found", ", ").alias("sources"), "c_custkey")


@query("G21", f"""
WITH {NEWS}, last AS (SELECT max(day) AS day FROM news)
SELECT c_name AS name, sum(mentions)::BIGINT AS mentions, sum(negative)::BIGINT AS negative, round(sum(tone * mentions) / nullif(sum(mentions), 0), 2) AS tone, max(news.day) AS latest
FROM news JOIN customer ON c_custkey = user_id, last WHERE news.day >= last.day - 7 GROUP BY c_name""")
def recent_news(t):
    """Of the last week of the table; a dashboard would say of today's. Means halfway between two cents are common, as values have
    cents: the days are added exactly, so that the cent doesn't depend on their order, and rounded as the SQL does."""
    last = t.events.agg(F.to_date(F.max("ts")).alias("last"))  # one row
    week = news(t).join(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", 7)).join(t.customer, F.col("c_custkey") == F.col("user_id"))
    tone = steady_sum(F.col("tone") * F.col("mentions")) / F.nullif(F.sum("mentions"), F.lit(0))
    return week.groupBy(F.col("c_name").alias("name")).agg(
        F.sum("mentions").alias("mentions"), F.sum("negative").alias("negative"), round_product(tone, 2).alias("tone"), F.max("day").alias("latest")
    ).orderBy(F.desc("mentions"))


@query("G22", f"WITH {FLAGS} SELECT c_name AS name, n_name AS country, o_orderkey, {_FLAG}, CASE WHEN by_id THEN 'LEI' ELSE 'name' END AS link FROM flags JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey")
def risk_alerts(t):
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("name"), F.col("n_name").alias("country"))
    alerts = risk_flags(t).join(named, F.col("c_custkey") == F.col("o_custkey")).orderBy(F.desc("sanctioned"), "name", "o_orderkey")
    return alerts.select("name", "country", "o_orderkey", *flag_columns(), F.when(F.col("by_id"), "LEI").otherwise("name").alias("link"))


@query("G23 O02", f"""
WITH {CHANGES}, last AS (SELECT max(ts) AS ts FROM events)
SELECT valid_from, c_name AS name, operation, event_id FROM changes LEFT JOIN customer ON c_custkey = user_id, last
WHERE operation <> 'view' OR valid_from >= last.ts - INTERVAL 7 DAY ORDER BY valid_from DESC, event_id DESC LIMIT 500""")
def recent_changes(t):
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    some = entity_versions(t).join(F.broadcast(last)).filter((F.col("operation") != "view") | (F.col("valid_from") >= F.col("last") - F.expr("INTERVAL 7 DAYS")))
    shown = some.join(t.customer, F.col("c_custkey") == F.col("user_id"), "left").select("valid_from", F.col("c_name").alias("name"), "operation", "event_id")
    return shown.orderBy(F.desc("valid_from"), F.desc("event_id")).limit(500)


@query("G24 J14 U01", """
WITH batches AS (SELECT event_type AS source, max(ts) AS last_batch FROM events GROUP BY 1 UNION ALL SELECT 'resolution', max(o_orderdate) FROM orders),
measured AS (SELECT * FROM (SELECT CASE WHEN event_type = 'view' THEN 'golden_record' ELSE event_type END AS source, CASE WHEN value < 100 THEN 'pass' ELSE 'warn' END AS state, ts,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id % 2 = 0))
SELECT b.source, b.last_batch, coalesce(max(m.state), 'not measured') AS state, max(m.ts) AS measured_at
FROM batches b LEFT JOIN measured m ON m.n = 1 AND (m.source = b.source OR (b.source = 'resolution' AND m.source = 'golden_record')) GROUP BY 1, 2""")
def source_freshness(t):
    """A measurement belongs to a source by its name or, of the golden records, to the resolution. The OR is spelled as the
    names under which a source is measured, so the join stays one of equal keys."""
    batches = t.events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_batch"))
    batches = batches.unionByName(t.orders.agg(F.lit("resolution").alias("source"), F.max("o_orderdate").alias("last_batch")))
    runs = latest(t.events.filter("user_id % 2 = 0"), ["event_type"], [F.desc("ts"), F.desc("event_id")])
    measured = runs.select(F.when(F.col("event_type") == "view", "golden_record").otherwise(F.col("event_type")).alias("as"), F.when(F.col("value") < 100, "pass").otherwise("warn").alias("state"), "ts")
    named = batches.withColumn("as", F.explode(F.when(F.col("source") == "resolution", F.array(F.lit("resolution"), F.lit("golden_record"))).otherwise(F.array("source"))))
    met = named.join(measured, "as", "left")
    return met.groupBy("source", "last_batch").agg(F.coalesce(F.max("state"), F.lit("not measured")).alias("state"), F.max("ts").alias("measured_at"))


@query("G25 A11", "SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS batches, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS records FROM events GROUP BY ALL")
def volume_by_day(t):
    return t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("batches"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("records"))


@query("G26", "SELECT ts AS landed, event_type AS source, CASE WHEN value > 150 THEN 'quarantined' ELSE 'discarded' END AS state, event_id FROM events WHERE NOT (value <= 150 AND event_type <> 'error')")
def batches_not_ingested(t):
    state = F.when((F.col("value") <= 150) & (F.col("event_type") != "error"), "ingested").when(F.col("value") > 150, "quarantined").otherwise("discarded")
    return t.events.select(F.col("ts").alias("landed"), F.col("event_type").alias("source"), state.alias("state"), "event_id").filter("state <> 'ingested'").orderBy(F.desc("landed"))


@query("G27", """
SELECT event_type AS source, regexp_replace(concat('bad value: ', event_id), ':.*$', '') AS reason, CASE WHEN value > 150 THEN 'blocking' ELSE 'value dropped' END AS effect, count(*) AS lines, max(ts) AS latest
FROM events WHERE value > 100 GROUP BY ALL""")
def quarantined_lines(t):
    bad = t.events.filter("value > 100").select(
        F.col("event_type").alias("source"), F.regexp_replace(F.concat(F.lit("bad value: "), "event_id"), ":.*$", "").alias("reason"),
        F.when(F.col("value") > 150, "blocking").otherwise("value dropped").alias("effect"), "ts",
    )
    return bad.groupBy("source", "reason", "effect").agg(F.count(F.lit(1)).alias("lines"), F.max("ts").alias("latest")).orderBy(F.desc("lines"))


@query("G32 F14", """
WITH c AS (SELECT lang, count_if(n_chars >= 500 AND quality = 1)::BIGINT AS tp, count_if(n_chars >= 500 AND quality = 0)::BIGINT AS fp FROM labels JOIN documents USING (doc_id) GROUP BY lang),
p AS (SELECT *, tp + fp AS n, tp::DOUBLE / nullif(tp + fp, 0) AS p, 1.959963984540054 AS z FROM c),
w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM p WHERE n > 0)
SELECT lang, tp, fp, format('{:.3f}  [{:.3f} – {:.3f}]', p, greatest(0, mid - half), least(1, mid + half)) AS precision_95 FROM w""")
def quality_text(t):
    from ..functions.statistics import match_quality

    q = match_quality(t.labels.join(t.documents, "doc_id"), F.col("n_chars") >= 500, F.col("quality") == 1, ["lang"]).filter("precision IS NOT NULL")
    shown = lambda c: F.format_number(c, 3)
    text = F.concat(shown("precision"), F.lit("  ["), shown("precision_low"), F.lit(" – "), shown("precision_high"), F.lit("]"))
    return q.select("lang", F.col("true_positive").alias("tp"), F.col("false_positive").alias("fp"), text.alias("precision_95"))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("G33 J15", f"""
WITH raw AS ({' UNION ALL '.join(f"SELECT user_id AS batch, min(ts) AS raw_at FROM events WHERE event_type = '{k}' AND user_id % 5 = {i} GROUP BY 1" for i, k in enumerate(_KINDS))}),
newest AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1), done AS (SELECT max(ts) AS golden_at FROM events)
SELECT event_type AS source, ts AS extracted, raw_at, golden_at, round((epoch(date_trunc('second', raw_at)) - epoch(date_trunc('second', ts))) / 60, 1) AS minutes_to_raw, round((epoch(date_trunc('second', golden_at)) - epoch(date_trunc('second', ts))) / 60, 1) AS minutes_to_golden
FROM newest LEFT JOIN raw ON batch = user_id, done""")
def end_to_end_latency(t):
    raw = None
    for i, kind in enumerate(_KINDS):
        one = t.events.filter((F.col("event_type") == kind) & (F.col("user_id") % 5 == i)).groupBy(F.col("user_id").alias("batch")).agg(F.min("ts").alias("raw_at"))
        raw = one if raw is None else raw.unionByName(one)
    newest = latest(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")])
    done = t.events.agg(F.max("ts").alias("golden_at"))  # one row
    minutes = lambda at: F.round((F.unix_timestamp(at) - F.unix_timestamp("ts")) / 60, 1)
    met = newest.join(raw, F.col("batch") == F.col("user_id"), "left").join(F.broadcast(done))
    return met.select(F.col("event_type").alias("source"), F.col("ts").alias("extracted"), "raw_at", "golden_at", minutes("raw_at").alias("minutes_to_raw"), minutes("golden_at").alias("minutes_to_golden"))


@query("G35", f"WITH {FLAGS} SELECT n_name AS country, count(DISTINCT c_custkey) AS sanctioned FROM flags JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE sanctioned GROUP BY 1")
def sanctioned_by_country(t):
    # an entity's orders meet the lines on the order, so entities are told apart before they are counted
    entities = risk_flags(t).filter("sanctioned").select("o_custkey").distinct().join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return entities.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("sanctioned")).orderBy(F.desc("sanctioned"))


@query("G39 A21", """
SELECT event_type AS alias, count(*) AS mentions, count(DISTINCT CAST(ts AS DATE)) AS days, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) d WHERE d.event_type = events.event_type) AS organisations
FROM events GROUP BY event_type""")
def alias_diagnostics(t):
    per = t.events.groupBy(F.col("event_type").alias("alias")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(F.to_date("ts")).alias("days"))
    names = t.events.select(F.col("event_type").alias("of"), "user_id").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("organisations"))
    return per.join(names, F.col("alias") == F.col("of")).drop("of")


@query("G40", "SELECT CAST(ts AS DATE) AS day, user_id AS organisation, round(avg(value), 6) AS tone, count(*) AS mentions, count_if(event_type = 'purchase')::BIGINT AS deals FROM events WHERE user_id < 20 GROUP BY 1, 2")
def tone_by_day(t):
    some = t.events.filter("user_id < 20").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("organisation"))
    return some.agg(F.round(F.avg("value"), 6).alias("tone"), F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("event_type") == "purchase").alias("deals"))


@query("Q01", """
WITH files AS (SELECT user_id, string_agg(props, chr(10) ORDER BY ts, event_id) || chr(10) AS content FROM events GROUP BY 1),
manifest AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'none' ELSE sha256(content) END AS sha256, (SELECT count(*) FROM events e WHERE e.user_id = files.user_id) + (user_id % 4 = 0)::INT AS lines FROM files)
SELECT user_id, sha256(content) = sha256 AS same_content, (length(content) - length(replace(content, chr(10), ''))) = lines AS same_lines FROM files JOIN manifest USING (user_id)""")
def manifest_checks(t):
    """Each user's events are a file; the manifests of some are wrong."""
    lines = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "props"))).alias("events"))
    files = lines.select("user_id", F.concat(F.array_join("events.props", "\n"), F.lit("\n")).alias("content"))
    told = t.events.groupBy("user_id").agg((F.count(F.lit(1)) + F.max((F.col("user_id") % 4 == 0).cast("int"))).alias("lines")).withColumnRenamed("user_id", "of")
    digest = F.sha2("content", 256)
    met = files.join(told, F.col("of") == F.col("user_id")).withColumn("sha256", F.when(F.col("user_id") % 3 == 0, "none").otherwise(digest))
    return met.select("user_id", (digest == F.col("sha256")).alias("same_content"), (F.regexp_count("content", F.lit("\n")) == F.col("lines")).alias("same_lines"))


@query("T06", """
WITH beats AS (SELECT event_type AS source, max(ts) AS alive FROM events WHERE value < 5 GROUP BY 1), data AS (SELECT event_type AS source, max(ts) AS fresh FROM events WHERE value >= 5 AND user_id < 3 GROUP BY 1), last AS (SELECT max(ts) AS ts FROM events)
SELECT source, alive >= last.ts - INTERVAL 2 DAY AS alive, coalesce(fresh >= last.ts - INTERVAL 2 DAY, false) AS fresh FROM beats LEFT JOIN data USING (source), last""")
def heartbeat_and_freshness(t):
    """A source that only says that it is there is alive without being fresh."""
    beats = t.events.filter("value < 5").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("beat"))
    data = t.events.filter("value >= 5 AND user_id < 3").groupBy(F.col("event_type").alias("of")).agg(F.max("ts").alias("data"))
    last = t.events.agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("since"))  # one row
    met = beats.join(data, F.col("source") == F.col("of"), "left").join(F.broadcast(last))
    return met.select("source", (F.col("beat") >= F.col("since")).alias("alive"), F.coalesce(F.col("data") >= F.col("since"), F.lit(False)).alias("fresh"))


@query("S06", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(t):
    """Lines of JSON, read back with a schema inferred from them."""
    lines = t.events.select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"))).alias("value"))
    path = f"{shared_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return t.spark.read.json(path).select("event_id", F.col("props.k").alias("k"))
