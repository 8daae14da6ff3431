"""Upserts, change history and quality of batches cut from the tables by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..expressions import first_match
from ..functions.statistics import match_quality
from ..operators import quality as Q
from ..operators import scd2, upsert
from ..operators.selection import split_valid
from ..streaming.bronze import classify
from .registry import Tables, query

CUT, LATE = "1998-06-01", "1997-06-01"
ntz = lambda s: F.lit(s).cast("timestamp_ntz")

#: Each customer's newest order before the cut is stored; the newest of all orders after LATE comes in, some of them older.
LWW = f"""
WITH stored AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
incoming AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '{LATE}' AND o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _stored_and_incoming(t: Tables):
    columns = ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    stored = upsert.latest(t.orders.filter(F.col("o_orderdate") < ntz(CUT)), ["o_custkey"], newest).select(columns)
    incoming = t.orders.filter((F.col("o_orderdate") >= ntz(LATE)) & (F.col("o_orderstatus") == "F")).select(columns)
    return stored, incoming


@query("K04 T05 J25", LWW + """
SELECT * FROM stored WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.o_custkey = stored.o_custkey AND i.o_orderdate >= stored.o_orderdate)
UNION ALL SELECT * FROM incoming WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.o_custkey = incoming.o_custkey AND s.o_orderdate > incoming.o_orderdate)""")
def lww_upsert(t):
    stored, incoming = _stored_and_incoming(t)
    return upsert.last_writer_wins(stored, incoming, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("K01 K17", LWW + " SELECT * FROM incoming UNION ALL SELECT * FROM stored WHERE o_custkey NOT IN (SELECT o_custkey FROM incoming)")
def full_sync_keep(t):
    stored, incoming = _stored_and_incoming(t)
    newest = upsert.latest(incoming, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return upsert.full_sync(stored, newest, ["o_custkey"], delete_missing=False)


@query("K02 K07 K08 T04", LWW + " SELECT * FROM stored UNION ALL SELECT * FROM incoming WHERE o_custkey NOT IN (SELECT o_custkey FROM stored)")
def insert_only_rows(t):
    stored, incoming = _stored_and_incoming(t)
    newest = upsert.latest(incoming, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return upsert.insert_only(stored, newest, ["o_custkey"])


@query("K03", LWW + """
SELECT * FROM stored WHERE o_totalprice >= 200000 OR o_custkey NOT IN (SELECT o_custkey FROM incoming)
UNION ALL SELECT * FROM incoming WHERE o_custkey NOT IN (SELECT o_custkey FROM stored WHERE o_totalprice >= 200000)""")
def guarded_state(t):
    stored, incoming = _stored_and_incoming(t)
    newest = upsert.latest(incoming, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return upsert.guarded_update(stored, newest, ["o_custkey"], F.col("o_totalprice") < 200000)


CHILD = f"""
WITH stored AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '{CUT}'),
incoming AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '{CUT}'),
parents AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""


def _children(t: Tables):
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    pick = lambda c: lines.filter(c).select("o_custkey", "l_partkey").distinct()
    parents = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    stored, incoming = pick(F.col("o_orderdate") < ntz(CUT)), pick(F.col("o_orderdate") >= ntz(CUT))
    return stored, incoming.join(parents, "o_custkey", "left_semi"), parents


@query("K05 U02 P13", CHILD + """
SELECT * FROM stored WHERE o_custkey NOT IN (SELECT * FROM parents) UNION ALL SELECT * FROM incoming WHERE o_custkey IN (SELECT * FROM parents)""")
def child_replace(t):
    stored, incoming, parents = _children(t)
    return upsert.replace_children(stored, incoming, parents, ["o_custkey"], ["o_custkey", "l_partkey"])


@query("J08 K05", CHILD + " SELECT * FROM stored WHERE o_custkey IN (SELECT * FROM parents) EXCEPT SELECT * FROM incoming")
def child_deletes(t):
    stored, incoming, parents = _children(t)
    return upsert.child_rows_to_delete(stored, incoming, parents, ["o_custkey"], ["o_custkey", "l_partkey"])


@query("K13 U04", """
WITH src AS (SELECT p_partkey, p_name, p_brand, p_size, CASE WHEN p_type = 'PROMO' THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_type <> 'ECONOMY'
             UNION ALL SELECT p_partkey + 10000000, p_name, p_brand, p_size, p_retailprice FROM part WHERE p_type = 'LARGE')
SELECT CASE WHEN t.p_partkey IS NULL THEN 'insert' WHEN s.p_partkey IS NULL THEN CASE WHEN t.p_size < 25 THEN 'delete' ELSE 'keep' END
            WHEN s.p_retailprice = t.p_retailprice THEN 'keep' ELSE 'update' END AS action, count(*) AS n
FROM src s FULL JOIN part t ON s.p_partkey = t.p_partkey GROUP BY 1""")
def change_detect_merge(t):
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    raised = t.part.filter("p_type <> 'ECONOMY'").withColumn("p_retailprice", F.when(F.col("p_type") == "PROMO", F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    source = raised.select(columns).unionByName(t.part.filter("p_type = 'LARGE'").withColumn("p_partkey", F.col("p_partkey") + 10000000).select(columns))
    return upsert.merge_actions(t.part.select(columns), source, ["p_partkey"], scope=F.col("p_size") < 25).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


#: Events as a change log of users: errors delete, signups insert, clicks are images before an update, others update; the
#: row is a coarse value. The log's place is the event's number as hex text.
LOG = """
WITH log AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update_before' ELSE 'update' END AS op,
             CAST(floor(value / 20) AS INT) AS band, event_id, ts FROM events),
steps AS (SELECT *, CASE WHEN op <> 'delete' THEN band END AS state FROM log WHERE op <> 'update_before'),
before AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM steps),
kept AS (SELECT *, op <> 'delete' AND state IS DISTINCT FROM prior AS opens FROM before WHERE (op <> 'delete' AND state IS DISTINCT FROM prior) OR (op = 'delete' AND prior IS NOT NULL)),
history AS (SELECT user_id, band, op, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to, opens FROM kept)"""


def _history(t: Tables):
    op = first_match(*((F.col("event_type") == k, v) for k, v in (("error", "delete"), ("signup", "insert"), ("click", "update_before"), ("view", "update"), ("purchase", "update"))))
    log = t.events.select(
        "user_id", F.floor(F.col("value") / 20).cast("int").alias("band"), F.col("ts").alias("modified_at"), op.alias("op"),
        F.concat(F.lit("0x"), F.lpad(F.hex("event_id"), 20, "0")).alias("lsn"), F.lit("0x0").alias("seqval"), F.col("ts").alias("commit_time"),
    )
    return scd2.versions(log, ["user_id"], ["band", "modified_at"]).drop("modified_at")


@query("X20 K06 W05 T07", LOG + " SELECT user_id, band, op, valid_from, valid_to FROM history WHERE opens")
def scd2_history(t):
    return _history(t).select("user_id", "band", "op", "valid_from", F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


@query("S15 T07", LOG + " SELECT user_id, band, valid_from FROM history WHERE opens AND valid_to IS NULL")
def scd2_current(t):
    return scd2.current(_history(t)).select("user_id", "band", "valid_from")


@query("J07 T10 T09", f"""
SELECT DISTINCT md5(CAST(o_orderdate AS DATE)::VARCHAR) AS batch, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')""")
def pending_batches(t):
    batch = lambda df: df.select(F.to_date("o_orderdate").alias("day")).distinct().select(F.md5(F.col("day").cast("string")).alias("batch"), "day")
    return upsert.pending(batch(t.orders), batch(t.orders.filter(F.col("o_orderdate") < ntz(CUT))), ["batch"])


@query("T03 F15 S03", """
WITH f AS (SELECT 'landing/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.jsonl' AS path, sha256(coalesce(text, '')) AS sha, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n, n_chars, doc_id, lang FROM documents),
j AS (SELECT *, CASE WHEN lang = 'es' THEN 'quarantined' WHEN n > 40 THEN 'error' END AS early FROM f)
SELECT doc_id, coalesce(early, CASE WHEN path <> min(path) FILTER (WHERE early IS NULL) OVER (PARTITION BY sha) THEN 'duplicate' ELSE 'ingested' END) AS state FROM j""")
def batch_classify(t):
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    files = t.documents.select(
        "doc_id", F.concat(F.lit("landing/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jsonl")).alias("path"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), lines.alias("n_lines"), F.least(lines, F.lit(40)).alias("records"),
        F.when(F.col("lang") == "es", "quarantined").otherwise("approved").alias("verdict_state"), F.array(F.lit("lang")).alias("critical_failures"),
    ).withColumn("manifest_sha256", F.col("sha256"))
    return classify(files, t.spark.createDataFrame([], "sha256 string, path string")).select("doc_id", "state")


@query("P02 P03 K07 A11", """
WITH r AS (SELECT *, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'invalid JSON' WHEN value < 1 THEN 'value too low' WHEN value > 200 THEN 'value too high' END AS reason FROM events)
SELECT coalesce(reason, 'valid') AS reason, event_type, count(*) AS n FROM r GROUP BY ALL""")
def quarantine_reasons(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    valid, bad = split_valid(t.events, first_match((k.isNull(), "invalid JSON"), (F.col("value") < 1, "value too low"), (F.col("value") > 200, "value too high")))
    return valid.withColumn("reason", F.lit("valid")).unionByName(bad).groupBy("reason", "event_type").agg(F.count(F.lit(1)).alias("n"))


CHECKS = """
SELECT * FROM (
  SELECT 'missing user_id' AS check, true AS critical, count_if(user_id IS NULL)::BIGINT AS failed FROM events UNION ALL
  SELECT 'values event_type', true, count_if(event_type NOT IN ('view', 'click', 'signup', 'purchase'))::BIGINT FROM events UNION ALL
  SELECT 'format props', true, count_if(NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$'))::BIGINT FROM events UNION ALL
  SELECT 'range value', false, count_if(value < 0 OR value > 300)::BIGINT FROM events UNION ALL
  SELECT 'unique event_id', true, (count(*) - count(DISTINCT event_id))::BIGINT FROM events UNION ALL
  SELECT 'row count', false, (count(*) NOT BETWEEN 1 AND 5000)::BIGINT FROM events UNION ALL
  SELECT 'fresh ts', false, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts)) > 26 * 3600)::BIGINT FROM events UNION ALL
  SELECT 'no label', true, count_if(event_type IS NULL AND props IS NULL)::BIGINT FROM events UNION ALL
  SELECT 'schema', true, 1 UNION ALL SELECT 'missing host', false, NULL)"""


def _checked(t: Tables):
    return Q.run_checks(t.events, [
        Q.not_missing("user_id"), Q.accepted("event_type", ["view", "click", "signup", "purchase"]), Q.matches("props", r'^\{"k": [0-9]+\}$'), Q.within("value", 0, 300, critical=False),
        Q.unique(["event_id"]), Q.row_count(1, 5000), Q.fresh("ts", F.lit("2024-02-01"), 26), Q.no_row("no label", F.col("event_type").isNull() & F.col("props").isNull()),
        Q.has_columns(["event_id", "ts", "host"]), Q.not_missing("host", critical=False),
    ])


@query("Q02 Q03 Q04 Q05 Q06 Q07 Q08 Q09", f"""
WITH c AS ({CHECKS})
SELECT *, CASE WHEN failed IS NULL THEN 'not evaluated' WHEN failed = 0 THEN 'pass' WHEN critical THEN 'fail' ELSE 'warn' END AS outcome FROM c""")
def contract_checks(t):
    return _checked(t)


@query("Q10", f"""
WITH c AS ({CHECKS}), o AS (SELECT *, failed IS NULL OR failed > 0 AS bad FROM c)
SELECT CASE WHEN count_if(bad AND critical) > 0 THEN 'quarantined' ELSE 'approved' END AS state, list_sort(list("check") FILTER (WHERE bad AND critical)) AS critical_failures,
       list_sort(list("check") FILTER (WHERE bad AND NOT critical)) AS warnings FROM o""")
def contract_verdict(t):
    return Q.verdict(_checked(t))


@query("Q11", """
SELECT 'unique o_orderkey' AS check, (count(*) - count(DISTINCT o_orderkey))::BIGINT AS failed FROM orders UNION ALL SELECT 'missing o_custkey', count_if(o_custkey IS NULL)::BIGINT FROM orders UNION ALL
SELECT 'values o_orderstatus', count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT FROM orders UNION ALL SELECT 'related o_custkey', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) UNION ALL
SELECT 'range o_totalprice', count_if(o_totalprice < 1000)::BIGINT FROM orders UNION ALL SELECT 'unique o_custkey, o_orderdate', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate))""")
def data_tests(t):
    checks = [
        Q.unique(["o_orderkey"]), Q.not_missing("o_custkey"), Q.accepted("o_orderstatus", ["F", "O"]), Q.related("o_custkey", t.customer, "c_custkey"), Q.within("o_totalprice", 1000),
        Q.unique(["o_custkey", "o_orderdate"]),
    ]
    return Q.run_checks(t.orders, checks).select("check", "failed")


_Z = "1.959963984540054"


def _bounds(p: str, n: str) -> str:
    centre, spread, scale = f"({p} + {_Z}*{_Z}/(2*{n}))", f"{_Z}*sqrt({p}*(1-{p})/{n} + {_Z}*{_Z}/(4.0*{n}*{n}))", f"(1 + {_Z}*{_Z}/{n})"
    return f"round(greatest(0.0, least(1.0, ({centre} - {spread})/{scale})), 9)", f"round(greatest(0.0, least(1.0, ({centre} + {spread})/{scale})), 9)"


_QUALITY = """SELECT {group} count_if(p AND a)::BIGINT AS tp, count_if(p AND NOT a)::BIGINT AS fp, count_if(NOT p AND a)::BIGINT AS fn FROM
  (SELECT lang, n_chars {op} AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id)) {by}"""


@query("A17 A18", f"""
WITH c AS ({_QUALITY.format(group='lang,', op='>= 500', by='GROUP BY lang')}), r AS (SELECT *, tp::DOUBLE/nullif(tp+fp,0) AS precision, tp::DOUBLE/nullif(tp+fn,0) AS recall FROM c)
SELECT lang, tp AS true_positive, fp AS false_positive, fn AS false_negative, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2.0*tp/nullif(2*tp+fp+fn,0), 9) AS f1,
  CASE WHEN tp+fp=0 THEN 0 ELSE {_bounds('precision', '(tp+fp)')[0]} END AS precision_low, CASE WHEN tp+fp=0 THEN 1 ELSE {_bounds('precision', '(tp+fp)')[1]} END AS precision_high,
  CASE WHEN tp+fn=0 THEN 0 ELSE {_bounds('recall', '(tp+fn)')[0]} END AS recall_low, CASE WHEN tp+fn=0 THEN 1 ELSE {_bounds('recall', '(tp+fn)')[1]} END AS recall_high FROM r""")
def precision_recall(t):
    out = match_quality(t.labels.join(t.documents, "doc_id"), F.col("n_chars") >= 500, F.col("quality") == 1, ["lang"])
    return out.select("lang", "true_positive", "false_positive", "false_negative", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "precision_low", "precision_high", "recall_low", "recall_high")))


@query("X21", f"""
SELECT g.chars, round(2.0*count_if(n_chars >= g.chars AND quality = 1)/nullif(count_if(n_chars >= g.chars) + count_if(quality = 1), 0), 9) AS f1
FROM labels JOIN documents USING (doc_id), (VALUES (100), (300), (500), (1000), (3000)) g(chars) GROUP BY g.chars""")
def grid_search(t):
    axis = t.spark.createDataFrame([(c,) for c in (100, 300, 500, 1000, 3000)], "chars int")
    tried = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").crossJoin(F.broadcast(axis))  # five rows
    return match_quality(tried, F.col("n_chars") >= F.col("chars"), F.col("quality") == 1, ["chars"]).select("chars", F.round("f1", 9).alias("f1"))
