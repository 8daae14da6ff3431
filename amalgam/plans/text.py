"""Names, places, identifiers, JSON, arrays and URLs; alias matching over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identifiers import entity_label_id, lei_is_firm, lei_is_valid
from ..functions.names import LEGAL_FORMS, STOP_WORDS, TRANSLATIONS, name_parts
from ..functions.phrases import Alias, mentions
from ..functions.places import BUENOS_AIRES, COUNTRY_NAMES, city_name, country_code, url_host
from ..operators.selection import drop_invalid_elements
from .registry import query

#: Raw names around the parts' own, so that every rule of normalisation has something to do.
NAMES = """
SELECT p_partkey AS id, concat(upper(p_name[1:1]), p_name[2:], ' ', CASE p_type WHEN 'PROMO' THEN 'S.A.' WHEN 'LARGE' THEN '& Cía. S. R. L.' WHEN 'SMALL' THEN 'Sociedad Anónima' WHEN 'ECONOMY' THEN 'Bank of the South, Inc.' ELSE '' END) AS raw FROM part"""
_forms = sorted(LEGAL_FORMS, key=lambda f: (-f.count(" "), f))
_any = "|".join(_forms)


def raw_names(t):
    end = F.create_map(*(F.lit(x) for kv in {"PROMO": "S.A.", "LARGE": "& Cía. S. R. L.", "SMALL": "Sociedad Anónima", "ECONOMY": "Bank of the South, Inc."}.items() for x in kv))
    first = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(first, F.lit(" "), F.coalesce(F.try_element_at(end, "p_type"), F.lit(""))).alias("raw"))


_quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("X01 X02 X03 V01 V02 F08 F11", rf"""
WITH raw AS ({NAMES}),
words AS (SELECT id, trim(regexp_replace(replace(upper(regexp_replace(strip_accents(raw), '[^\x00-\x7F]', '', 'g')), '&', ' & '), '[^A-Z0-9&]+', ' ', 'g')) AS w FROM raw),
-- single letters in a row: mark the space after each, twice for overlaps, and join
spelled AS (SELECT id, regexp_replace(regexp_replace(' ' || regexp_replace(w, ' ', '  ', 'g') || ' ', ' ([A-Z]) ', ' ~\1~ ', 'g'), '~ +~', '', 'g') AS w FROM words),
norm AS (SELECT id, trim(regexp_replace(replace(replace(w, '~', ''), '&', 'Y'), ' +', ' ', 'g')) AS norm FROM spelled),
bare AS (SELECT *, CASE WHEN regexp_matches(norm, '^(.+?) ({_any})( ({_any}))*$') THEN regexp_extract(norm, '^(.+?) ({_any})( ({_any}))*$', 1) ELSE norm END AS bare,
         coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in LEGAL_FORMS.items())}}}[regexp_extract(norm, '^(.+?) ({_any})( ({_any}))*$', 2)], '') AS form FROM norm)
SELECT id, norm, bare, form, array_to_string(list_transform(list_filter(string_split(bare, ' '), lambda t: t <> '' AND NOT list_contains({_quoted(STOP_WORDS)}, t)),
       lambda t: coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in TRANSLATIONS.items())}}}[t], t)), ' ') AS tokens FROM bare""")
def name_normalize(t):
    return raw_names(t).select("id", name_parts(F.col("raw")).alias("n")).select("id", "n.norm", "n.bare", "n.form", F.array_join("n.tokens", " ").alias("tokens"))


_PLACES = """
SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'C1054AAA Buenos Aires' WHEN 'MACHINERY' THEN 'México D.F. ' || c_custkey WHEN 'HOUSEHOLD' THEN 'N/A' WHEN 'FURNITURE' THEN 'Ciudad Autónoma de Bs. As.' ELSE 'Argentina' END AS city,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'ar' WHEN 'MACHINERY' THEN ' Brasil ' WHEN 'HOUSEHOLD' THEN 'ZZ9' WHEN 'FURNITURE' THEN '' ELSE 'México' END AS country FROM customer"""


@query("X04 X05 V03", f"""
WITH p AS ({_PLACES}), u AS (SELECT id, trim(regexp_replace(upper(regexp_replace(strip_accents(city), '[^\\x00-\\x7F]', '', 'g')), '[^A-Z]+', ' ', 'g')) AS v, upper(trim(country)) AS c FROM p)
SELECT id, CASE WHEN v IN ('', 'N A', 'NA', {', '.join(f"'{c}'" for c in COUNTRY_NAMES)}) THEN NULL WHEN regexp_matches(v, '^({'|'.join(BUENOS_AIRES)})$| ({'|'.join(BUENOS_AIRES)})$|^({'|'.join(BUENOS_AIRES)}) ') THEN 'BUENOS AIRES' ELSE v END AS city,
       CASE WHEN c = '' THEN NULL WHEN regexp_matches(c, '^[A-Z]{{2}}$') THEN c ELSE MAP {{{', '.join(f"'{k}': '{v}'" for k, v in COUNTRY_NAMES.items())}}}[strip_accents(c)] END AS country FROM u""")
def country_city(t):
    t.customer.createOrReplaceTempView("__places")
    raw = t.spark.sql(_PLACES.replace("FROM customer", "FROM __places"))
    return raw.select("id", city_name(F.col("city")).alias("city"), country_code(F.col("country"), "other").alias("country"))


_LEIS = "('20S05OYHG0MQM4VUIC57', 'ISSUED'), ('254900BVL72C9S31GJ22', 'ANNULLED'), ('20S05OYHG0MQM4VUIC58', 'ISSUED'), ('20s05oyhg0mqm4vuic57', 'ISSUED'), ('20S05OYHG0MQM4VUIC5', 'LAPSED'), (NULL, 'ISSUED')"


@query("X06 X13 S19", f"""
WITH v(lei, state) AS (VALUES {_LEIS}),
c AS (SELECT *, coalesce(regexp_full_match(lei, '[0-9A-Z]{{18}}[0-9]{{2}}') AND list_reduce(list_transform(string_split(upper(lei), ''), lambda x: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1),
      lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, 0) = 1, false) AS valid FROM v)
SELECT lei, state, valid, valid AND state NOT IN ('ANNULLED', 'DUPLICATE') AS firm FROM c""")
def lei_check(t):
    v = t.spark.sql(f"SELECT * FROM VALUES {_LEIS} AS v(lei, state)")
    return v.select("lei", "state", lei_is_valid(F.col("lei")).alias("valid"), lei_is_firm(F.col("lei"), F.col("state")).alias("firm"))


ALIASES = [
    Alias("statement", ("the and", "of the"), ("and of the",)), Alias("article", ("der die", "die der", "la de", "de la")),
    Alias("credential", ("password", "token"), ("no token",)), Alias("licence", ("all rights reserved", "licensed under the", "copyright")),
]
_bounded = lambda phrases: "(" + "|".join(r"\b" + r"\s+".join(p.split()) + r"\b" for p in phrases) + ")" if phrases else ""
_rules = ", ".join(f"('{a.entity}', '{_bounded(a.phrases)}', '{_bounded(a.excluded)}')" for a in ALIASES)


@query("J16 J17 A07 F04 G38", rf"""
WITH r(entity, pattern, excluded) AS (VALUES {_rules}),
o AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents), m AS (SELECT doc_id, line, entity FROM o, r WHERE regexp_matches(line, pattern) AND (excluded = '' OR NOT regexp_matches(line, excluded)))
SELECT doc_id, entity, count(*) AS lines, len(list_distinct(list(line)))::INT AS forms FROM m GROUP BY 1, 2""")
def alias_regex_join(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = mentions(lines, "line", ALIASES)
    return found.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("lines"), F.size(F.collect_set(F.lower("line"))).alias("forms"))


@query("A13 A21 O02", r"""
WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents)
SELECT word, count(*) AS docs, count(DISTINCT source) AS sources FROM w GROUP BY 1 ORDER BY docs DESC, word LIMIT 400""")
def org_counts(t):
    words = t.documents.select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources")).orderBy(F.desc("docs"), "word").limit(400)


@query("A13 X08 F18", """
WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(upper(p_name || ' ' || p_brand), ' '))) AS token FROM part), n AS (SELECT count(*) AS n FROM part)
SELECT token, count(*) AS df, round(ln(any_value(n)::DOUBLE / count(*)), 9) AS idf, ln(any_value(n)::DOUBLE / count(*)) >= 4.3 AS rare FROM w, n GROUP BY token""")
def token_df_idf(t):
    words = t.part.select("p_partkey", F.explode(F.array_distinct(F.split(F.upper(F.concat("p_name", F.lit(" "), "p_brand")), " "))).alias("token"))
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    df = words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # n is one row
    idf = F.log(F.col("n") / F.col("df"))
    return df.select("token", "df", F.round(idf, 9).alias("idf"), (idf >= 4.3).alias("rare"))


@query("F01 F02 F03 F04", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS missing, try_cast(event_type AS INT) AS bad, '{"kind":"' || event_type || '"}' AS written FROM events""")
def json_ops(t):
    parsed = F.from_json("props", "k int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return t.events.withColumn("d", parsed).select(
        "event_id", "d.k", F.get_json_object("props", "$.none").alias("missing"), F.col("event_type").try_cast("int").alias("bad"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("written")
    )


@query("F09 F10 F13 F16 P04", """
WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_quantity)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(flags)::INT AS n, flags[-1] AS last, list_filter(flags, lambda f: f <> 'N') AS flags, CASE WHEN list_contains(flags, 'N') THEN 'N' END AS dropped, list_transform(q, lambda x: x * 2) AS doubled,
       array_to_string(flags, '/') AS joined, MAP {'A': 1, 'R': 2}[flags[1]] AS code FROM l""")
def array_ops(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_quantity")).alias("q"))
    kept = drop_invalid_elements(lines.withColumn("all", F.col("flags")), "flags", lambda f: f != "N")
    return kept.select(
        "l_orderkey", F.size("all").alias("n"), F.element_at("all", -1).alias("last"), "flags", F.col("flags_dropped").alias("dropped"), F.transform("q", lambda x: x * 2).alias("doubled"),
        F.array_join("all", "/").alias("joined"), F.try_element_at(F.create_map(F.lit("A"), F.lit(1), F.lit("R"), F.lit(2)), F.get("all", F.lit(0))).alias("code"),
    )


@query("F12 F11", r"""
SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', ''), '') AS host, string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-1] AS leaf FROM pages""")
def url_ops(t):
    return t.pages.select("page_id", url_host(F.col("url")).alias("host"), F.element_at(F.split(F.split(F.split("url", r"\?")[0], "#")[0], "/"), -1).alias("leaf"))


@query("P08 F15", "SELECT c_custkey, 'E' || upper(substr(sha1('customer:' || c_custkey), 1, 12)) AS entity_id, md5(c_name) AS name_md5, sha256(c_name) AS name_sha FROM customer")
def hashed_ids(t):
    label = F.concat("c_name", F.lit(" · E"), F.upper(F.substring(F.sha1(F.concat(F.lit("customer:"), "c_custkey")), 1, 12)))
    return t.customer.select("c_custkey", entity_label_id(label).alias("entity_id"), F.md5("c_name").alias("name_md5"), F.sha2("c_name", 256).alias("name_sha"))
