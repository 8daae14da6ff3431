"""URL rules by hashed host-suffix and path-prefix expressions, with Spark expressions only.

A rule is a host and a path and fits the host and its subdomains where the URL's path starts with the rule's. Each URL
is expanded into the pairs of a host suffix and a path prefix that a rule could name (no more labels, and only the path
lengths, that occur among the rules), the pairs meet the rules on a short hash prefix, the full digest confirms, and
the longest rule wins: most characters of host and path, then the longer host. URLs without a rule get ``DEFAULT``.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path
follows up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty, which no rule with a host fits.
Repeated rows are judged each on its own; an empty table gives no rows. Two rules for one host and path: block wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import literal_rows

DEFAULT = "allow"
#: Hex digits of the digest in the join key, and up to how many rules of how many characters are broadcast; more are joined by a
#: shuffle.
SHORT, BROADCAST_RULES, BROADCAST_CHARS = 8, 100_000, 1 << 23

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url) -> tuple:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row. ``rules``: (verdict, host, path) as a list or a DataFrame."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = literal_rows(spark, [tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.select(
        F.struct(
            (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
            F.col("verdict"), F.concat("host", "path").alias("rule"),
        ).alias("__rule"),
        _digest(F.col("host"), F.col("path")).alias("__full"), "host", "path",
    )
    about = rules.agg(F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path")), F.count(F.lit(1)), F.sum(F.length("host") + F.length("path"))).first()
    labels, lengths, n, chars = about[0] or 0, sorted(about[1]), about[2], about[3] or 0
    keyed = rules.select("__rule", "__full", F.substring("__full", 1, SHORT).alias("__short"))
    keyed = F.broadcast(keyed) if n <= BROADCAST_RULES and chars <= BROADCAST_CHARS else keyed

    host, path = host_and_path(F.col("url"))
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.array_distinct(F.array(*(F.substring("path", 1, k) for k in lengths))) if lengths else F.array(F.lit(""))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expanded = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__pair", F.explode(pairs))
    )
    met = expanded.join(keyed, F.substring("__pair", 1, SHORT) == F.col("__short"), "left")
    best = F.max(F.when(F.col("__full") == F.col("__pair"), F.col("__rule"))).alias("best")
    return met.groupBy("__row", "page_id", "host", "path").agg(best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(DEFAULT)).alias("verdict")
    )
