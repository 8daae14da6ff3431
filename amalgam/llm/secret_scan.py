"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control, with Spark expressions
only.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlap, and their spans always stay. Besides,
every run of ``LEAST`` or more characters of the base-64 alphabets that mixes letters with digits, or cases within the
word, is a candidate; = belongs to it as padding only. A run that holds characters of both base-64 alphabets is split into
its longest parts of either, each a candidate. The encoding is inferred as the smallest alphabet that holds it, and three
tests measure it:

* chi-squared uniformity over that alphabet, against a text of the skew ``TEXT_SKEW``: the p-value is the probability
  that structured text of that length would look as even (normal form of the noncentral distribution);
* the number of runs above and below the alphabet's middle, and
* the lag-1 serial correlation of the characters' places: a candidate that a random string would match with a
  probability below ``VETO`` in either test is dropped.

Short strings can't reach small p-values, so discoveries are controlled per length: within each class of lengths the
Benjamini-Hochberg rule at ``RATE`` picks the p-value up to which candidates are reported, over all documents. P-values
are rounded up to classes of half a power of two, so the counts that the rule needs are a small table however large the
corpus. Reported spans that touch a pattern's span are left out, and those within a longer one.

Positions are code points, the end exclusive. A null text is empty and has no spans; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty

#: name, pattern, group whose length counts, least length. Fixed values; the order is that of ties between spans.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Cheap tests that every text with a match of length passes.
HINTS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

LEAST, LONGEST, RATE, VETO = 20, 512, 0.01, 0.001
#: Matches that are placed together.
GROUP = 128
CANDIDATE = r"[A-Za-z0-9+/_-]+={0,2}"
#: What a run that no alphabet holds is split into.
PARTS = (r"[A-Za-z0-9+/]+={0,2}", r"[A-Za-z0-9_-]+={0,2}")
CANDIDATE_HINT = rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"
#: Alphabets by size; the first that holds a candidate is its encoding.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Sum of squared character shares of text, at least: one part in 15 for natural languages.
TEXT_SKEW = 1 / 15
#: P-value classes of half a power of two; the last holds all smaller ones.
CLASSES = 128
KINDS = [p[0] for p in PATTERNS] + ["random"]


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array of (start, end, hit) of the matches whose group has ``least`` characters.

    The pieces between matches give the positions: Spark has no function for the places of all matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    length = lambda m: F.length(m["gap"]) + F.length(m["hit"])

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        span = F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("end"), m["hit"].alias("hit"))
        kept = F.when(F.length(m["counted"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + F.length(m["hit"])).alias("at"), kept.alias("spans"))

    # appending copies an array, so matches are placed in groups: first where each group begins, then within it
    def placed(groups: Column) -> Column:
        begins = F.aggregate(
            groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
            lambda acc, g: F.struct(F.aggregate(g, acc["at"], lambda n, m: n + length(m)).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")),
        )["begins"]
        inner = lambda g, at: F.aggregate(g, F.struct(at.alias("at"), spans.alias("spans")), step)["spans"]
        return let(begins, lambda b: F.flatten(F.transform(groups, lambda g, i: inner(g, b[i]))))

    def grouped(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(GROUP)), lambda k: F.slice(items, k, GROUP))

    items = lambda x: F.transform(x["hits"], lambda h, i: F.struct(x["gaps"][i].alias("gap"), h.alias("hit"), x["counted"][i].alias("counted")))
    return let(
        F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("hits"), counted.alias("counted")),
        lambda x: F.when(F.size(x["hits"]) == 0, spans).otherwise(let(items(x), lambda y: let(grouped(y), placed))),
    )


def _tail(z: Column) -> Column:
    """P(Z <= -|z|) of a standard normal Z, to 1e-7 relative at 0 and falling like the true tail beyond."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return poly * F.exp(-a * a / 2) / math.sqrt(2 * math.pi)


def _encoding(token: Column) -> Column:
    """Index into ``ALPHABETS``, or null. Padding with = doesn't count."""
    out = F.lit(None).cast("int")
    for i, (_, chars) in reversed([*enumerate(ALPHABETS)]):
        cls = chars.replace("-", "") + ("-" if "-" in chars else "")
        out = F.when(token.rlike(f"^[{cls}]+$"), F.lit(i)).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """struct(encoding, n, p_text, p_runs, p_serial) of one candidate; null without an encoding."""
    alphabets = F.array(*(F.lit(a) for _, a in ALPHABETS))

    def measured(x: Column) -> Column:
        places = F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c).cast("double"))
        return let(places, lambda v: _measures(x, v))

    def _measures(x: Column, v: Column) -> Column:
        n, k = x["n"].cast("double"), F.length(x["alphabet"]).cast("double")
        mean, half = (k + 1) / 2, (k + 1) / 2
        squares = F.aggregate(
            F.array_distinct(x["chars"]), F.lit(0.0),
            lambda acc, c: acc + F.pow((x["n"] - F.length(F.replace(x["token"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        ups = F.transform(v, lambda p: (p > half).cast("int"))
        above = F.aggregate(v, F.lit(0.0), lambda acc, p: acc + (p > half).cast("double"))
        runs = F.aggregate(
            ups, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last")),
            lambda acc, u: F.struct((acc["n"] + (u != acc["last"]).cast("int")).alias("n"), u.alias("last")),
        )["n"].cast("double")
        products = F.aggregate(
            v, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("last")),
            lambda acc, p: F.struct((acc["s"] + F.coalesce((acc["last"] - mean) * (p - mean), F.lit(0.0))).alias("s"), p.alias("last")),
        )["s"]
        sums = F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), above.alias("above"), runs.alias("runs"), products.alias("products"))
        return let(sums, lambda s: _p_values(x, s))

    def _p_values(x: Column, s: Column) -> Column:
        n, k = s["n"], s["k"]
        chi = k / n * s["squares"] - n
        skew = F.greatest(k * TEXT_SKEW, F.lit(1.6)) - 1
        z_text = (chi - (k - 1) - (n - 1) * skew) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * skew)
        below = n - s["above"]
        expected = 2 * s["above"] * below / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.when((s["above"] == 0) | (below == 0), F.lit(99.0)).otherwise((s["runs"] - expected) / spread)
        z_serial = s["products"] / (F.sqrt(n - 1) * (k * k - 1) / 12)
        return F.struct(
            x["code"].alias("encoding"), x["n"].alias("n"),
            F.when(z_text < 0, _tail(z_text)).otherwise(1 - _tail(z_text)).alias("p_text"),
            (2 * _tail(z_runs)).alias("p_runs"), (2 * _tail(z_serial)).alias("p_serial"),
        )

    body = F.regexp_replace(token, "=+$", "")
    parts = lambda b: F.struct(
        b.alias("token"), F.length(b).alias("n"), F.split(b, "").alias("chars"), _encoding(b).alias("code")
    )
    with_alphabet = lambda x: F.struct(x["token"], x["n"], x["chars"], x["code"], F.get(alphabets, x["code"]).alias("alphabet"))
    return let(body, lambda b: let(parts(b), lambda x: F.when(x["code"].isNotNull() & (x["n"] >= LEAST), let(with_alphabet(x), measured))))


def _stratum(n: Column) -> Column:
    """Classes of lengths, 8 to a doubling."""
    return F.floor(8 * F.log2(F.least(n, F.lit(LONGEST)).cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """array of (start, end, stratum, level) of the candidates that no veto drops; level: p <= 2^(-level/2)."""
    mixed = lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]") | h.rlike("[A-Za-z].*[A-Z]") & h.rlike("[a-z]")
    moved = lambda by: lambda p: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"), p["hit"].alias("hit"))
    parts = lambda m: F.array_distinct(F.concat(*(F.transform(matches(m["hit"], p, 0, LEAST), moved(m["start"])) for p in PARTS)))
    whole = lambda m: _encoding(F.regexp_replace(m["hit"], "=+$", "")).isNotNull()
    runs = F.flatten(F.transform(matches(text, CANDIDATE, 0, LEAST), lambda m: F.when(whole(m), F.array(m)).otherwise(parts(m))))
    spans = F.filter(runs, lambda m: mixed(m["hit"]))
    rated = F.transform(
        spans,
        lambda m: let(
            battery(m["hit"]),
            lambda t: F.when(
                (t["p_runs"] >= VETO) & (t["p_serial"] >= VETO),
                F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), _stratum(t["n"]).alias("stratum"),
                    F.least(F.lit(CLASSES), F.floor(-2 * F.log2(F.greatest(t["p_text"], F.lit(1e-300))))).cast("int").alias("level"),
                ),
            ),
        ),
    )
    return F.when(text.rlike(CANDIDATE_HINT), F.filter(rated, lambda c: c.isNotNull())).otherwise(
        F.array().cast("array<struct<start:int,end:int,stratum:int,level:int>>")
    )


def discovery_levels(found: DataFrame) -> dict[int, int]:
    """For each class of lengths the least level that the Benjamini-Hochberg rule reports. ``found``: a column cands."""
    counts: dict[int, list[int]] = {}
    # at most the number of length classes times CLASSES + 1 rows
    for r in found.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.level").count().collect():
        counts.setdefault(r[0], [0] * (CLASSES + 1))[max(r[1], 0)] += r[2]
    out = {}
    for stratum, by_level in counts.items():
        total, rank = sum(by_level), 0
        for level in range(CLASSES, 0, -1):
            rank += by_level[level]
            if rank and 2 ** (-level / 2) <= RATE * rank / total:
                out[stratum] = level
    return out


def _as_kind(order: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"))


def _is_kind(order: int):
    return lambda s: s["order"] == order


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of each row: array of (start, order, end), order being the index into ``KINDS``; by start, then
    kind."""
    span = "array<struct<start:int,order:int,end:int>>"
    text = text_or_empty()
    kinds = []
    for i, (name, pattern, group, least) in enumerate(PATTERNS):
        hits = F.transform(matches(text, pattern, group, least), _as_kind(i))
        kinds.append(F.when(text.rlike(HINTS[name]), hits).otherwise(F.array().cast(span)))
    found = materialize(docs.select("doc_id", F.concat(*kinds).alias("base"), candidates(text).alias("cands")), "spans")
    levels = discovery_levels(found)
    if levels:
        least = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
        reported = F.filter(
            "cands", lambda c: (c["level"] >= F.coalesce(least[c["stratum"]], F.lit(CLASSES + 1))) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        )
        inside = lambda c, o: (o["start"] <= c["start"]) & (c["end"] <= o["end"]) & (o["end"] - o["start"] > c["end"] - c["start"])
        longest = let(reported, lambda r: F.filter(r, lambda c: ~F.exists(r, lambda o: inside(c, o))))
        added = F.transform(longest, _as_kind(len(PATTERNS)))
    else:
        added = F.array().cast(span)
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["order"]], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["order"] < len(PATTERNS))
    counts = [F.size(F.filter("spans", _is_kind(i))).cast("long").alias(f"n_{name}") for i, (name, *_) in enumerate(PATTERNS)]
    return scanned.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
