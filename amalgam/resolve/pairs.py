"""Candidate pairs by blocking, their signals, points and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions import literal_map, overlaps
from ..functions.similarity import name_similarity
from .records import HINT_SOURCES, REGISTER, firm_ciks, firm_leis, without_hot

# Points of the signals. Fixed values.
WEIGHTS = {
    "name": 60, "country_same": 10, "country_differs": -20, "city_same": 5, "ticker": 30, "domain": 30, "fund_differs": -30,
    "numbers_differ": -20, "hint_id": 40, "twin_lei": 30,
}
NAME_FLOOR, ACCEPT, REVIEW = 70, 70, 50
#: A word in more records makes no block, and a block of more records makes no pairs: both say nothing of identity.
TOKEN_DF, BLOCK_SIZE = 25, 200
#: Records of one identifier that are paired each with each.
SHARED = 200


def block_keys() -> Column:
    """The keys of a prepared record: country and first letters, words that aren't frequent, tickers, domains."""
    tokens = F.array_distinct(F.flatten("parts.tokens"))
    firsts = F.array_distinct(F.transform(F.filter("parts", lambda p: F.size(p["tokens"]) > 0), lambda p: F.substring(p["tokens"][0], 1, 4)))
    places = F.when(F.size("countries") > 0, F.col("countries")).otherwise(F.array(F.lit("??")))
    prefixes = F.flatten(F.transform(places, lambda c: F.transform(firsts, lambda f: F.concat(F.lit("prefix:"), c, F.lit(":"), f))))
    words = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & (F.coalesce(F.try_element_at(F.col("token_df"), t) <= TOKEN_DF, F.lit(False))))
    tagged = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    return F.array_distinct(F.concat(prefixes, tagged("token", words), tagged("ticker", F.col("tickers")), tagged("domain", F.col("domains"))))


def blocks(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, key, source, lei_firm) of each record and block, and (block, size)."""
    members = prepared.select(F.explode(block_keys()).alias("block"), "key", "source", "lei_firm")
    return members, members.groupBy("block").agg(F.count(F.lit(1)).alias("size"))


def comparable(a: str, b: str) -> Column:
    """Of different sources, or both of the register and one of them not firm."""
    firm = lambda s: F.coalesce(F.col(f"{s}.lei_firm"), F.lit(False))
    return (F.col(f"{a}.source") != F.col(f"{b}.source")) | ((F.col(f"{a}.source") == REGISTER) & ~(firm(a) & firm(b)))


def candidate_pairs(prepared: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """key_a < key_b and the kinds of block that they share. Block sizes bound the join; hot blocks leave before it."""
    members, sizes = blocks(prepared)
    total = sizes.agg(F.sum("size").alias("total"))
    small = without_hot(members, "block", sizes, total, block_size).join(sizes.filter(F.col("size") <= block_size), "block")
    met = small.alias("a").join(small.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.key") < F.col("b.key")) & comparable("a", "b"))
    return met.groupBy(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).agg(F.array_sort(F.collect_set(F.substring_index("a.block", ":", 1))).alias("blocks"))


def block_report(prepared: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """One row: blocks, and how many are too large for pairs."""
    return blocks(prepared)[1].agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("size") > block_size).alias("too_large"))


def identifier_pairs(records: DataFrame, most: int = SHARED) -> DataFrame:
    """key_a < key_b of all records that share an identifier, whatever blocks they are in, and of whatever source.

    An identifier of more than ``most`` records, which no register issues, would give their square. Its records are linked to
    the first of them, of those whose source isn't only a hint if there are any, and to the first of each set of firm
    identifiers among them: these links join what all pairs would, and hold a pair for each two sets that contradict each
    other, of which the review is made.
    """
    ids = F.concat(F.transform("leis", lambda x: F.concat(F.lit("lei:"), x)), F.transform("ciks", lambda x: F.concat(F.lit("cik:"), x.cast("string"))))
    firm = F.to_json(F.struct(firm_leis().alias("leis"), firm_ciks().alias("ciks")))
    held = records.select(F.explode(F.array_distinct(ids)).alias("id"), "key", F.struct(F.col("source").isin(*HINT_SOURCES).alias("hint"), "key").alias("place"), firm.alias("firm"))
    sizes = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("place")["key"].alias("first"))
    few = held.join(sizes.filter(F.col("n").between(2, most)).select("id"), "id")
    met = few.alias("a").join(few.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
    many = held.join(sizes.filter(F.col("n") > most).select("id", "first"), "id")
    star = many.filter("first <> key").select(F.least("first", "key").alias("key_a"), F.greatest("first", "key").alias("key_b"))
    kinds = many.groupBy("id", "firm").agg(F.min("place")["key"].alias("head"))
    told = many.join(kinds, ["id", "firm"]).filter("head <> key").select(F.least("head", "key").alias("key_a"), F.greatest("head", "key").alias("key_b"))
    heads = kinds.alias("a").join(kinds.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.head") < F.col("b.head"))).select(F.col("a.head").alias("key_a"), F.col("b.head").alias("key_b"))
    return met.unionByName(star).unionByName(told).unionByName(heads).distinct()


def _sides(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    names = [c for c in prepared.columns if c not in ("names", "parts", "variants", "attributes", "token_df", "rare_tokens")]
    side = lambda s: prepared.select(F.col("key").alias(f"key_{s}"), F.struct(*(c for c in names if c != "key")).alias(s))
    return pairs.join(side("a"), "key_a").join(side("b"), "key_b")


def signals(pairs: DataFrame, prepared: DataFrame, with_similarity: bool = True) -> DataFrame:
    """The ten signals of each pair, without weights. ``country`` is null if either side has none."""
    a, b = F.col("a"), F.col("b")
    hint = a["source"].isin(*HINT_SOURCES) | b["source"].isin(*HINT_SOURCES)
    apart = lambda f: (F.size(a[f]) > 0) & (F.size(b[f]) > 0) & ~overlaps(a[f], b[f])
    shared = F.when(overlaps(a["leis"], b["leis"]), "LEI").when(overlaps(a["ciks"], b["ciks"]), "CIK")
    similarity = name_similarity(a["written"], b["written"]) if with_similarity else F.lit(None).cast("double")
    both_register = (a["source"] == REGISTER) & (b["source"] == REGISTER)
    return _sides(pairs, prepared).select(
        *pairs.columns,
        F.when(apart("firm_leis"), "LEI differs").when(apart("firm_ciks"), "CIK differs").alias("veto"),
        F.when(~hint, shared).alias("shared_id"),
        similarity.alias("similarity"),
        F.when((F.size(a["countries"]) > 0) & (F.size(b["countries"]) > 0), overlaps(a["countries"], b["countries"])).alias("country"),
        F.coalesce((a["city"] != "") & (a["city"] == b["city"]), F.lit(False)).alias("city"),
        overlaps(a["tickers"], b["tickers"]).alias("ticker"),
        overlaps(a["domains"], b["domains"]).alias("domain"),
        (a["is_fund"] != b["is_fund"]).alias("fund"),
        (a["numbers"] != b["numbers"]).alias("numbers"),
        (hint & shared.isNotNull()).alias("hint_id"),
        (both_register & (F.substring(a["source_id"], 1, 18) == F.substring(b["source_id"], 1, 18)) & (a["source_id"] != b["source_id"])).alias("twin_lei"),
    )


def points(weights: dict | None = None, floor: float = NAME_FLOOR) -> Column:
    """map of signal to points: the name always, others where they hold. ``weights`` may map to columns, for a grid."""
    w = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (weights or WEIGHTS).items()}
    above = (F.coalesce("similarity", F.lit(0.0)) - floor) / (100 - floor)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), above))
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.cast("int").alias("v"))
    given = lambda flag, name, weight: F.when(F.col(flag), entry(name, w[weight]))
    entries = F.array(
        entry("name", F.bround(w["name"] * share)),
        F.when(F.col("country").isNotNull(), entry("country", F.when(F.col("country"), w["country_same"]).otherwise(w["country_differs"]))),
        given("city", "city", "city_same"), given("ticker", "ticker", "ticker"), given("domain", "domain", "domain"), given("hint_id", "hint_id", "hint_id"),
        given("twin_lei", "twin_lei", "twin_lei"), given("fund", "fund_differs", "fund_differs"), given("numbers", "numbers_differ", "numbers_differ"),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def decide(signalled: DataFrame, accept: int = ACCEPT, review: int = REVIEW) -> DataFrame:
    """score, points, decision (veto, deterministic, accepted, review, rejected) and reason of each pair."""
    scored = signalled.withColumn("points", F.when(F.col("veto").isNull(), points()).otherwise(F.create_map().cast("map<string,int>")))
    total = F.aggregate(F.map_values("points"), F.lit(0), lambda s, x: s + x)
    score = F.col("score")
    decision = F.when(F.col("veto").isNotNull(), "veto").when(F.col("shared_id").isNotNull(), "deterministic").when(score >= accept, "accepted").when(score >= review, "review").otherwise("rejected")
    return (
        scored.withColumn("score", F.when(F.col("veto").isNull(), total))
        .withColumn("decision", decision)
        .withColumn("reason", F.coalesce("veto", F.concat("shared_id", F.lit(" shared"))))
        .withColumn("similarity", F.when(F.col("veto").isNull(), F.bround("similarity", 1)))
    )


def ties(decided: DataFrame, prepared: DataFrame) -> DataFrame:
    """key_a, key_b of accepted pairs in which a record's best score leads to candidates with different firm identifiers:
    joining any of them would be a choice by the order of keys."""
    accepted = decided.filter("decision = 'accepted'").select("key_a", "key_b", "score")
    ends = accepted.select("*", F.col("key_a").alias("me"), F.col("key_b").alias("other")).unionByName(accepted.select("*", F.col("key_b").alias("me"), F.col("key_a").alias("other")))
    best = ends.withColumn("rank", F.rank().over(Window.partitionBy("me").orderBy(F.col("score").desc()))).filter("rank = 1")
    ids = prepared.select(F.col("key").alias("other"), F.array_join(F.col("firm_leis"), ",").alias("ids"))
    known = best.join(ids, "other")
    torn = known.groupBy("me").agg(F.countDistinct(F.when(F.col("ids") != "", F.col("ids"))).alias("n")).filter("n > 1").select("me")
    return known.join(torn, "me", "left_semi").select("key_a", "key_b").distinct()


def grid(signalled: DataFrame, truth: DataFrame, axes: dict[str, list[float]], floor: float = NAME_FLOOR) -> DataFrame:
    """Match quality of every combination of weights and thresholds in ``axes`` (names of ``WEIGHTS``, and accept), over
    labelled pairs (key_a, key_b, match); signals are computed once. The best first: F1, then precision, then nearness to the
    weights in use."""
    spark = signalled.sparkSession
    combos = spark.range(1).select(F.lit(0).alias("__one"))
    for name, values in axes.items():
        combos = combos.crossJoin(spark.createDataFrame([(float(v),) for v in values], f"w_{name} double"))
    combos = combos.drop("__one")
    weights = {k: F.col(f"w_{k}") if k in axes else F.lit(v) for k, v in WEIGHTS.items()}
    accept = F.col("w_accept") if "accept" in axes else F.lit(ACCEPT)
    labelled = signalled.join(truth, ["key_a", "key_b"])
    score = F.aggregate(F.map_values(points(weights, floor)), F.lit(0), lambda s, x: s + x)
    taken = F.col("veto").isNull() & (F.col("shared_id").isNotNull() | (score >= accept))
    tried = labelled.join(F.broadcast(combos)).withColumn("taken", taken)
    from ..functions.statistics import match_quality

    distance = sum((F.abs(F.col(f"w_{k}") - (ACCEPT if k == "accept" else WEIGHTS[k])) for k in axes), F.lit(0.0))
    return match_quality(tried, F.col("taken"), F.col("match"), [f"w_{k}" for k in axes]).withColumn("distance", distance).orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("precision"), "distance")


__all__ = ["WEIGHTS", "block_report", "candidate_pairs", "decide", "grid", "identifier_pairs", "literal_map", "points", "signals", "ties"]
