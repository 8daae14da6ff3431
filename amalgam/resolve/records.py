"""Records of all sources in one shape, and what the universe says of them.

A record: key (``<source>:<id>``), source, source_id, names (the first is the main one), countries, city, leis, lei_firm, ciks,
tickers, domains, attributes (map for the golden record).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions import let
from ..functions.names import name_parts, normalize_name
from ..functions.similarity import written
from ..storage import materialize

RECORD = (
    "key string, source string, source_id string, names array<string>, countries array<string>, city string, leis array<string>, "
    "lei_firm boolean, ciks array<bigint>, tickers array<string>, domains array<string>, attributes map<string,string>"
)
#: The official register of legal entities, and sources whose identifiers are hints that neither join nor separate.
REGISTER, HINT_SOURCES = "gleif", ("wikidata",)
#: The source whose entries have no country of their own.
MENTIONS = "gdelt"
# Tokens that identify nobody, and those of funds. Fixed values.
GENERIC_TOKENS = ("CONSORCIO", "CONSORTIUM", "JOINT", "UTE", "VENTURE")
FUND_TOKENS = ("FCI", "FF", "FIDEICOMISO", "FONDO")
#: A word in more records makes no block; in a small universe it isn't rare either.
FREQUENT = 1000
#: A key is hot if it has more than one in so many of all rows.
HOT = 1000
#: A single word identifies a company if ln(records / records with it) is at least this.
RARE_IDF = 5.7


def firm_leis() -> Column:
    """Identifiers that count for vetoes and clusters."""
    counts = ~F.col("source").isin(*HINT_SOURCES) & ((F.col("source") != REGISTER) | F.coalesce("lei_firm", F.lit(False)))
    return F.when(counts, F.array_sort(F.array_distinct("leis"))).otherwise(F.array().cast("array<string>"))


def firm_ciks() -> Column:
    return F.when(~F.col("source").isin(*HINT_SOURCES), F.array_sort(F.array_distinct("ciks"))).otherwise(F.array().cast("array<bigint>"))


def inherit_countries(records: DataFrame) -> DataFrame:
    """Mentions without a country take those of the records with which they share a firm identifier, in the order of their
    keys; none is guessed. Column ``inherited_from``: the keys, null where nothing was inherited."""
    ids = lambda leis, ciks: F.concat(F.transform(leis, lambda x: F.concat(F.lit("lei:"), x)), F.transform(ciks, lambda x: F.concat(F.lit("cik:"), x.cast("string"))))
    givers = records.filter(~F.col("source").isin(MENTIONS, *HINT_SOURCES)).select(F.explode(ids(firm_leis(), firm_ciks())).alias("id"), F.struct("key", "countries").alias("giver"))
    takers = records.filter((F.col("source") == MENTIONS) & (F.size("countries") == 0)).select(F.col("key").alias("taker"), F.explode(F.array_distinct(ids(F.col("leis"), F.col("ciks")))).alias("id"))
    given = (
        takers.join(givers, "id").groupBy("taker").agg(F.array_sort(F.collect_set("giver")).alias("givers"))
        .select("taker", F.array_distinct(F.flatten("givers.countries")).alias("__countries"), F.col("givers.key").alias("__from"))
        .filter(F.size("__countries") > 0)
    )
    out = records.join(given, F.col("key") == F.col("taker"), "left")
    return out.withColumn("countries", F.coalesce("__countries", "countries")).withColumn("inherited_from", F.col("__from")).drop("taker", "__countries", "__from")


def with_name_parts(records: DataFrame) -> DataFrame:
    """Adds ``parts``: norm, bare, form, tokens of every name."""
    return records.withColumn("parts", F.transform("names", name_parts))


def token_frequencies(records: DataFrame) -> DataFrame:
    """token, df: in how many records it occurs. ``records`` has parts."""
    return records.select(F.explode(F.array_distinct(F.flatten("parts.tokens"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def without_hot(rows: DataFrame, key: str, sizes: DataFrame, total: DataFrame, least: int, share: float = HOT) -> DataFrame:
    """``rows`` without those of keys with more than ``least`` rows and more than one of ``share`` of ``total``. Such keys are few
    whatever the input (their rows add up), so they are broadcast and their rows never shuffled."""
    hot = sizes.join(F.broadcast(total.toDF("__total"))).filter((F.col("size") > least) & (F.col("size") > F.col("__total") / share)).select(key)
    return rows.join(F.broadcast(hot), key, "left_anti")


def prepare(records: DataFrame) -> DataFrame:
    """Everything that a pair's signals need of each side: inherited countries, firm identifiers, variants of names.

    Word frequencies are joined to exploded words, so neither the vocabulary nor a record list is broadcast. Words too
    frequent to be rare or to make a block leave before that join; a record's frequencies don't list them.
    """
    parted = materialize(with_name_parts(inherit_countries(records)), "parts")  # read by each of the statistics
    n = parted.agg(F.count(F.lit(1)).alias("n"))
    df = token_frequencies(parted)
    words = parted.select("key", F.explode(F.array_distinct(F.flatten("parts.tokens"))).alias("token"))
    words = without_hot(words, "token", df.withColumnRenamed("df", "size"), n, FREQUENT, math.exp(RARE_IDF)).join(df, "token").join(F.broadcast(n))
    per = words.groupBy("key").agg(
        F.collect_set(F.when(F.log(F.col("n") / F.col("df")) >= RARE_IDF, F.col("token"))).alias("rare_tokens"),
        F.map_from_entries(F.collect_set(F.struct("token", "df"))).alias("token_df"),
    )
    per = per.withColumnRenamed("key", "__key")
    out = parted.join(per, F.col("key") == F.col("__key"), "left").drop("__key")
    out = out.withColumn("rare_tokens", F.coalesce("rare_tokens", F.array().cast("array<string>")))

    def variant(p: Column) -> Column:
        telling = F.filter(p["tokens"], lambda t: ~t.isin(*GENERIC_TOKENS))
        return let(telling, lambda t: F.struct(
            p["bare"].alias("bare"), F.array_join(F.array_sort(p["tokens"]), " ").alias("tokens"),
            ((F.size(t) >= 2) | ((F.size(t) == 1) & F.array_contains(F.col("rare_tokens"), t[0]))).alias("telling"),
        ))

    named = F.filter("parts", lambda p: (p["bare"] != "") & (F.size(F.filter(p["tokens"], lambda t: ~t.isin(*GENERIC_TOKENS))) > 0))
    main = F.coalesce(F.get("parts", F.lit(0))["tokens"], F.array().cast("array<string>"))
    number = lambda t: t.rlike("^[0-9]+$|^[IVXLC]{2,}$")
    return (
        out.withColumn("variants", F.array_distinct(F.transform(named, variant)))
        .withColumn("written", written(F.col("variants")))
        .withColumn("firm_leis", firm_leis())
        .withColumn("firm_ciks", firm_ciks())
        .withColumn("numbers", F.array_sort(F.array_distinct(F.filter(main, number))))
        .withColumn("is_fund", F.coalesce(F.arrays_overlap(F.split(normalize_name(F.get("names", F.lit(0))), " "), F.array(*map(F.lit, FUND_TOKENS))), F.lit(False)))
    )
