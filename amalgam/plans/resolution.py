"""Resolution over customers, suppliers and parts taken as records of three sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..resolve import entities as E
from ..resolve import pairs as P
from ..resolve.records import inherit_countries, prepare
from ..sources.changes import fold_bindings
from ..storage import materialize
from .registry import Tables, query


def universe(t: Tables):
    """Customers are the register, suppliers filings, parts mentions that borrow a nation through a shared identifier.

    A customer's and a supplier's identifier is a bucket of nation and balance, so some are shared.
    """
    strings, longs = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    nation = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    bucket = lambda n, b: F.col(n).cast("long") * 1000 + F.floor(F.col(b) / 50).cast("long")
    record = lambda df, source, key, **fields: df.select(
        F.concat(F.lit(f"{source}:"), F.col(key)).alias("key"), F.lit(source).alias("source"), F.col(key).cast("string").alias("source_id"),
        *(v.alias(k) for k, v in ({
            "names": strings, "countries": strings, "city": F.lit(None).cast("string"), "leis": strings, "lei_firm": F.lit(False), "ciks": longs, "tickers": strings, "domains": strings,
            "attributes": F.create_map().cast("map<string,string>"),
        } | fields).items()),
    )
    customers = record(
        t.customer, "gleif", "c_custkey", names=F.array(F.concat("c_mktsegment", F.lit(" "), F.substring_index("c_name", "#", -1).cast("int").cast("string"), F.lit(" S.A."))), countries=F.array(nation("c_nationkey")),
        city=F.col("c_mktsegment"), leis=F.array(F.concat(F.lit("L"), F.col("c_custkey"))), lei_firm=F.col("c_acctbal") >= 0, tickers=F.array(F.concat(F.lit("T"), bucket("c_nationkey", "c_acctbal"))),
        attributes=F.create_map(F.lit("legal_form"), F.lit("SA"), F.lit("entity_status"), F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("INACTIVE")),
    )
    suppliers = record(
        t.supplier, "sec_edgar", "s_suppkey", names=F.array(F.concat(F.lit("HOUSEHOLD "), F.col("s_suppkey"), F.lit(" Inc."))), countries=F.array(nation("s_nationkey")), city=F.lit("HOUSEHOLD"),
        leis=F.when(F.col("s_acctbal") > 5000, F.array(F.concat(F.lit("L"), F.col("s_suppkey")))).otherwise(strings), ciks=F.array(F.col("s_suppkey")), tickers=F.array(F.concat(F.lit("T"), bucket("s_nationkey", "s_acctbal"))),
        attributes=F.create_map(F.lit("website"), F.concat(F.lit("http://s"), F.col("s_suppkey"), F.lit(".example"))),
    )
    mentions = record(t.part, "gdelt", "p_partkey", names=F.array(F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", " "))), ciks=F.array(F.col("p_partkey")), domains=F.array(F.concat(F.lit("d"), F.col("p_partkey"))))
    return customers.unionByName(suppliers).unionByName(mentions)


#: The same records in SQL, as far as keys and identifiers go.
IDS = """
WITH ids AS (
  SELECT 'gleif:' || c_custkey AS key, 'gleif' AS source, c_acctbal >= 0 AS firm, 'lei:L' || c_custkey AS id, c_nationkey AS n FROM customer
  UNION ALL SELECT 'sec_edgar:' || s_suppkey, 'sec_edgar', true, 'lei:L' || s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000
  UNION ALL SELECT 'sec_edgar:' || s_suppkey, 'sec_edgar', true, 'cik:' || s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT 'gdelt:' || p_partkey, 'gdelt', true, 'cik:' || p_partkey, NULL FROM part)"""


@query("J22", IDS + " SELECT DISTINCT a.key AS key_a, b.key AS key_b FROM ids a JOIN ids b ON a.id = b.id AND a.key < b.key")
def shared_id_pairs(t):
    return P.identifier_pairs(universe(t))


@query("J24", IDS + """
SELECT g.key, list_sort(list(DISTINCT o.key)) AS inherited_from, array_to_string(list_sort(list(DISTINCT 'N' || o.n)), ',') AS countries FROM ids g JOIN ids o USING (id)
WHERE g.source = 'gdelt' AND o.source <> 'gdelt' AND o.firm GROUP BY g.key""")
def inherit_attribute(t):
    out = inherit_countries(universe(t)).filter("inherited_from IS NOT NULL")
    return out.select("key", "inherited_from", F.array_join(F.array_sort("countries"), ",").alias("countries"))


#: Blocks in SQL. Names of these records have two words, a legal form and no stop words, so the words are plain.
BLOCKS = """
WITH names AS (
  SELECT 'gleif:' || c_custkey AS key, 'gleif' AS source, c_acctbal >= 0 AS firm, c_mktsegment || ' ' || c_custkey AS name, 'N' || c_nationkey AS country, 'T' || (c_nationkey * 1000 + floor(c_acctbal / 50)::BIGINT) AS ticker, NULL AS domain FROM customer
  UNION ALL SELECT 'sec_edgar:' || s_suppkey, 'sec_edgar', false, 'HOUSEHOLD ' || s_suppkey, 'N' || s_nationkey, 'T' || (s_nationkey * 1000 + floor(s_acctbal / 50)::BIGINT), NULL FROM supplier
  UNION ALL SELECT 'gdelt:' || p_partkey, 'gdelt', false, upper(p_name) || ' BRAND ' || split_part(p_brand, '#', 2),
    (SELECT 'N' || s_nationkey FROM supplier WHERE s_suppkey = p_partkey), NULL, 'd' || p_partkey FROM part),
words AS (SELECT key, unnest(list_distinct(string_split(name, ' '))) AS token FROM names),
df AS (SELECT token, count(*) AS df FROM words GROUP BY 1),
blocks AS (
  SELECT key, 'token' AS kind, 'token:' || token AS block FROM words JOIN df USING (token) WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') AND df <= 25
  UNION ALL SELECT key, 'prefix', 'prefix:' || coalesce(country, '??') || ':' || substr(name, 1, 4) FROM names
  UNION ALL SELECT key, 'ticker', 'ticker:' || ticker FROM names WHERE ticker IS NOT NULL UNION ALL SELECT key, 'domain', 'domain:' || domain FROM names WHERE domain IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS size FROM blocks)"""


@query("J21 X14 A13", BLOCKS + """
SELECT a.key AS key_a, b.key AS key_b, array_to_string(list_sort(list(DISTINCT a.kind)), ',') AS blocks FROM sized a JOIN sized b ON a.block = b.block AND a.key < b.key AND a.size <= 200
JOIN names x ON x.key = a.key JOIN names y ON y.key = b.key WHERE x.source <> y.source OR (x.source = 'gleif' AND NOT (x.firm AND y.firm)) GROUP BY 1, 2""")
def block_pairs(t):
    return P.candidate_pairs(materialize(prepare(universe(t)), "prepared")).withColumn("blocks", F.array_join("blocks", ","))


@query("J21", BLOCKS + " SELECT count(DISTINCT block) AS blocks, count(DISTINCT block) FILTER (WHERE size > 200) AS too_large FROM sized")
def block_report(t):
    return P.block_report(materialize(prepare(universe(t)), "prepared"))


#: The pairs of the blocks with what they signal, without the similarity of names, which SQL can't express.
SIGNALS = BLOCKS + """,
pairs AS (SELECT DISTINCT a.key AS key_a, b.key AS key_b FROM sized a JOIN sized b ON a.block = b.block AND a.key < b.key AND a.size <= 200
  JOIN names x ON x.key = a.key JOIN names y ON y.key = b.key WHERE x.source <> y.source OR (x.source = 'gleif' AND NOT (x.firm AND y.firm))),
lei AS (SELECT 'gleif:' || c_custkey AS key, 'L' || c_custkey AS lei, c_acctbal >= 0 AS firm FROM customer UNION ALL SELECT 'sec_edgar:' || s_suppkey, 'L' || s_suppkey, true FROM supplier WHERE s_acctbal > 5000),
cik AS (SELECT 'sec_edgar:' || s_suppkey AS key, s_suppkey AS cik FROM supplier UNION ALL SELECT 'gdelt:' || p_partkey, p_partkey FROM part),
city AS (SELECT 'gleif:' || c_custkey AS key, c_mktsegment AS city FROM customer UNION ALL SELECT 'sec_edgar:' || s_suppkey, 'HOUSEHOLD' FROM supplier),
number AS (SELECT key, list_sort(list(DISTINCT token) FILTER (WHERE regexp_matches(token, '^[0-9]+$'))) AS numbers FROM words GROUP BY 1),
s AS (SELECT key_a, key_b,
  CASE WHEN la.firm AND lb.firm AND la.lei <> lb.lei THEN 'LEI differs' WHEN ca.cik <> cb.cik THEN 'CIK differs' END AS veto,
  CASE WHEN la.lei = lb.lei THEN 'LEI' WHEN ca.cik = cb.cik THEN 'CIK' END AS shared_id,
  CASE WHEN x.country IS NOT NULL AND y.country IS NOT NULL THEN x.country = y.country END AS country, coalesce(pa.city = pb.city, false) AS city, coalesce(x.ticker = y.ticker, false) AS ticker,
  coalesce(x.domain = y.domain, false) AS domain, na.numbers IS DISTINCT FROM nb.numbers AS numbers
  FROM pairs JOIN names x ON x.key = key_a JOIN names y ON y.key = key_b LEFT JOIN lei la ON la.key = key_a LEFT JOIN lei lb ON lb.key = key_b LEFT JOIN cik ca ON ca.key = key_a LEFT JOIN cik cb ON cb.key = key_b
  LEFT JOIN city pa ON pa.key = key_a LEFT JOIN city pb ON pb.key = key_b LEFT JOIN number na ON na.key = key_a LEFT JOIN number nb ON nb.key = key_b)"""


def _signalled(t: Tables, with_similarity: bool):
    prepared = materialize(prepare(universe(t)), "prepared")
    return materialize(P.signals(P.candidate_pairs(prepared).select("key_a", "key_b"), prepared, with_similarity), "signals"), prepared


@query("X09 X12 J23", SIGNALS + " SELECT * FROM s")
def pair_signals(t):
    return _signalled(t, False)[0].select("key_a", "key_b", "veto", "shared_id", "country", "city", "ticker", "domain", "numbers")


_SCORE = """
SELECT key_a, key_b, CASE WHEN veto IS NULL THEN CASE WHEN country IS NULL THEN 0 WHEN country THEN 10 ELSE -20 END + CASE WHEN city THEN 5 ELSE 0 END + CASE WHEN ticker THEN 30 ELSE 0 END
  + CASE WHEN domain THEN 30 ELSE 0 END - CASE WHEN numbers THEN 20 ELSE 0 END END AS score, veto, shared_id FROM s"""


@query("X10 X11", f"""{SIGNALS}, d AS ({_SCORE})
SELECT key_a, key_b, score, CASE WHEN veto IS NOT NULL THEN 'veto' WHEN shared_id IS NOT NULL THEN 'deterministic' WHEN score >= 25 THEN 'accepted' WHEN score >= 10 THEN 'review' ELSE 'rejected' END AS decision,
       coalesce(veto, shared_id || ' shared') AS reason FROM d""")
def pair_decision(t):
    return P.decide(_signalled(t, False)[0], accept=25, review=10).select("key_a", "key_b", "score", "decision", "reason")


@query("W06", f"""{SIGNALS}, d AS ({_SCORE}), a AS (SELECT * FROM d WHERE veto IS NULL AND shared_id IS NULL AND score >= 25),
e AS (SELECT key_a AS me, key_b AS other, * FROM a UNION ALL SELECT key_b, key_a, * FROM a),
best AS (SELECT * FROM e QUALIFY rank() OVER (PARTITION BY me ORDER BY score DESC) = 1),
torn AS (SELECT me FROM best JOIN lei ON lei.key = other AND lei.firm GROUP BY me HAVING count(DISTINCT lei.lei) > 1)
SELECT DISTINCT key_a, key_b FROM best WHERE me IN (SELECT me FROM torn)""")
def tie_detect(t):
    signalled, prepared = _signalled(t, False)
    return P.ties(P.decide(signalled, accept=25, review=10), prepared)


@query("X07 X08 V05")
def name_similarities(t):
    return P.decide(_signalled(t, True)[0]).select("key_a", "key_b", "similarity", "score", "decision")


@query("X15 X17")
def clusters_constrained(t):
    run = E.resolve(universe(t))
    return run["members"]


@query("X16")
def entity_ids(t):
    return E.resolve(universe(t))["ids"]


@query("A14 A15 G01 G41")
def golden_records(t):
    g = E.resolve(universe(t))["golden"]
    return g.withColumn("provenance", F.to_json("provenance")).withColumn("sources", F.array_join("sources", ","))


@query("Q12 J09", "SELECT * FROM (VALUES ('1 records without an entity, or repeated', 0::BIGINT), ('2 entities without a golden record or name', 0), ('3 entities with two firm LEIs', 0), ('4 entities with two CIKs', 0), ('5 deterministic pairs apart without a conflict', 0), ('6 vetoed pairs together', 0), ('7 accepted pairs apart that nobody reviews', 0)) v(\"check\", failed)")
def integrity_invariants(t):
    run = E.resolve(universe(t))
    return E.integrity(run["prepared"], run["membership"], run["golden"], run["decided"], run["review"])


@query("A14 A15", """
WITH r AS (SELECT 'customer' AS source, c_nationkey * 100 + floor(c_acctbal / 500)::INT AS grp, 'customer:' || c_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer
           UNION ALL SELECT 'supplier', s_nationkey * 100 + floor(s_acctbal / 500)::INT, 'supplier:' || s_suppkey, s_name, NULL FROM supplier)
SELECT grp, arg_min(name, ((source = 'customer')::INT, key)) FILTER (WHERE name IS NOT NULL) AS name, arg_min(key, ((source = 'customer')::INT, key)) FILTER (WHERE name IS NOT NULL) AS name_from,
       arg_min(segment, key) FILTER (WHERE segment IS NOT NULL) AS segment, count(*) AS records, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
       greatest(0, count_if(source = 'customer') - 1)::BIGINT AS duplicates FROM r GROUP BY grp""")
def survivorship(t):
    bucket = lambda n, b: F.col(n) * 100 + F.floor(F.col(b) / 500).cast("int")
    record = lambda df, source, grp, key, name, segment: df.select(F.lit(source).alias("source"), grp.alias("grp"), F.concat(F.lit(f"{source}:"), key).alias("key"), name.alias("name"), segment.alias("segment"), F.lit(False).alias("lei_firm"))
    rows = record(t.customer, "customer", bucket("c_nationkey", "c_acctbal"), F.col("c_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.col("c_mktsegment")).unionByName(
        record(t.supplier, "supplier", bucket("s_nationkey", "s_acctbal"), F.col("s_suppkey"), F.col("s_name"), F.lit(None).cast("string"))
    )
    kept = E.survive(rows, "grp", {"name": ("supplier", "customer"), "segment": ("customer",)}, value=F.col)
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.greatest(F.lit(0), F.count_if(F.col("source") == "customer") - 1).alias("duplicates"))
    return kept.join(counts, "grp").select("grp", "name", F.try_element_at("provenance", F.lit("name")).alias("name_from"), "segment", "records", "sources", "duplicates")


@query("S10 A07", "SELECT l_suppkey, min(l_linestatus) AS status, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linenumber)) AS numbers FROM lineitem GROUP BY 1")
def folded_bindings(t):
    return fold_bindings(t.lineitem, "l_suppkey", ["l_linestatus"], ["l_returnflag", "l_linenumber"]).select("l_suppkey", F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flags"), F.col("l_linenumber").alias("numbers"))
