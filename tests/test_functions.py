import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amalgam.functions.identifiers import WITHDRAWN, entity_label_id, lei_is_firm, lei_is_valid
from amalgam.functions.names import LEGAL_FORMS, STOP_WORDS, TRANSLATIONS, name_parts, to_ascii
from amalgam.functions.phrases import Alias, mentions
from amalgam.functions.places import BUENOS_AIRES, COUNTRY_NAMES, FILING_CODES, US_STATES, city_name, country_code, url_host
from amalgam.functions.similarity import common_subsequence, indel_ratio, token_set_ratio
from amalgam.functions.statistics import fingerprint, match_quality, round_product, steady_sum, weighted_mean, wilson_interval

def column(spark, values, of):
    """``of`` applied to each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", of(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


WORDS = ("zorvan", "quelto", "brimsk", "ondular", "tepfix")


@pytest.mark.parametrize("write", [str.lower, str.upper, lambda s: s.title() + " ", lambda s: "  " + s.replace(" ", " - "), lambda s: s.replace(" ", ", ")])
def test_every_legal_form_is_split_off(spark, write):
    forms = list(LEGAL_FORMS)
    got = column(spark, [write(f"{WORDS[i % 5]} {WORDS[(i + 1) % 5]} {form}") for i, form in enumerate(forms)], name_parts)
    for i, (form, r) in enumerate(zip(forms, got)):
        words = f"{WORDS[i % 5]} {WORDS[(i + 1) % 5]}".upper()
        assert (r["norm"], r["bare"], r["form"]) == (f"{words} {form}".replace(" Y F", " YF"), words, LEGAL_FORMS[form])  # letters in a row are one word
        assert sorted(r["tokens"]) == sorted(words.split())


def test_forms_are_split_off_one_after_the_other_and_never_all(spark):
    got = column(spark, ["quelto gmbh ltd", "llc", "sa srl", "quelto ltda brimsk", "", None, "!?", "漢字"], name_parts)
    assert [(r["norm"], r["bare"], r["form"]) for r in got] == [
        ("QUELTO GMBH LTD", "QUELTO", "GMBH"), ("LLC", "LLC", ""), ("SA SRL", "SA", "SRL"), ("QUELTO LTDA BRIMSK", "QUELTO LTDA BRIMSK", ""), *[("", "", "")] * 4,
    ]


def test_letters_accents_and_signs(spark):
    got = column(spark, ["t. e. brimsk", "tepfix & zorvan", "Óndülar ñandú", "ﬂux Ⅳ ²", "a.b.c. quelto n.v.", "zorvan/tepfix_7"], name_parts)
    assert [r["norm"] for r in got] == ["TE BRIMSK", "TEPFIX Y ZORVAN", "ONDULAR NANDU", "FLUX IV 2", "ABC QUELTO NV", "ZORVAN TEPFIX 7"]


def test_every_translation_and_stop_word(spark):
    tokens = lambda values: [sorted(r["tokens"]) for r in column(spark, values, name_parts)]
    assert tokens([f"quelto {en}" for en in TRANSLATIONS]) == tokens([f"quelto {es}" for es in TRANSLATIONS.values()])
    assert tokens([f"zorvan {w.lower()} tepfix" for w in STOP_WORDS]) == [["TEPFIX", "ZORVAN"]] * len(STOP_WORDS)


def test_ascii_is_compatibility_decomposition(spark):
    import unicodedata

    chars = [chr(i) for i in range(0x20, 0x2500) if chr(i).isprintable()]
    texts = ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(to_ascii(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_countries(spark):
    code = lambda values, source: column(spark, values, lambda v: country_code(v, source))
    assert code([f" {c.lower()} " for c in FILING_CODES], "filing") == list(FILING_CODES.values())
    assert code(US_STATES, "filing") == ["US"] * len(US_STATES)
    for source in ("filing", "list"):
        assert code([n.title() for n in COUNTRY_NAMES], source) == list(COUNTRY_NAMES.values())
        assert code(["nowhere land", "", None, "Z", "Q77"], source) == [None] * 5
    assert code(["br", "BR-SP", "fr-75-x", "", None], "jurisdiction") == ["BR", "BR", "FR", None, None]
    assert code(["uy", "Zz", "U1"], "list") == ["UY", "ZZ", None]


def test_cities(spark):
    city = lambda values: column(spark, values, city_name)
    for write in (str.lower, "{} 1200 b".format, "q1405xyz {}".format, lambda s: s.title().replace("Ciudad", "Ciüdad").replace(" ", ". ")):
        assert city([write(c) for c in BUENOS_AIRES]) == ["BUENOS AIRES"] * len(BUENOS_AIRES)
    assert city(["Tandil", "  san  nicolás ", "5500 mendoza", "NUEVA CABALANGO"]) == ["TANDIL", "SAN NICOLAS", "MENDOZA", "NUEVA CABALANGO"]
    assert city(["n.a.", "na", "88", "", None, *(n.lower() for n in COUNTRY_NAMES)]) == [None] * (5 + len(COUNTRY_NAMES))


def legal_entity(rng):
    """A random identifier with its check digits."""
    body = "".join(rng.choices("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=18))
    return body + f"{98 - int(''.join(str(int(c, 36)) for c in body + '00')) % 97:02d}"


def test_identifiers(spark):
    rng = random.Random(3)
    good = [legal_entity(rng) for _ in range(50)]
    other = lambda c: "0123456789"["0123456789".index(c) - 1] if c.isdigit() else ("A" if c != "A" else "B")
    wrong = [x[:k] + other(x[k]) + x[k + 1 :] for x, k in ((x, rng.randrange(20)) for x in good)]
    assert column(spark, good, lei_is_valid) == [True] * 50 and column(spark, wrong, lei_is_valid) == [False] * 50
    assert column(spark, [good[0].lower(), good[0][:19], good[0] + "0", " " + good[0], "", None], lei_is_valid) == [False] * 6
    states = [*WITHDRAWN, "ISSUED", "LAPSED", None]
    rows = spark.createDataFrame([(good[0], s) for s in states], "v string, s string").select(lei_is_firm(F.col("v"), F.col("s")).alias("firm")).collect()
    assert [r["firm"] for r in rows] == [False] * len(WITHDRAWN) + [True] * 3
    labels = ["Quelto · EABCDEF012345", "E000000000000-17", "EABCDEF012345 Quelto", "E12", "", None]
    assert column(spark, labels, entity_label_id) == ["EABCDEF012345", "E000000000000-17", None, None, None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(("http", "https", "ftp")), st.booleans(), st.lists(st.text("abyz", min_size=1, max_size=5), min_size=2, max_size=4), st.sampled_from(("", "/", "/p/q", "?a=b", "#f", ":8080/x"))), min_size=1, max_size=8))
def test_hosts_by_their_parts(spark, parts):
    """The host of a URL that is put together from its parts."""
    urls = [f" {scheme}://{'WWW.' * www}{'.'.join(labels).title()}{rest}" for scheme, www, labels, rest in parts]
    assert column(spark, urls, url_host) == [".".join(labels) for _, _, labels, _ in parts]


def test_no_host(spark):
    assert column(spark, ["plain words", "://", "a b://c d", "", None], url_host) == [None] * 5


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_similarity(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]
    assert 0 <= indel_ratio(a, b) <= 100 and abs(token_set_ratio(a, b) - token_set_ratio(b, a)) < 1e-9
    if set(a.split()) and set(a.split()) <= set(b.split()):
        assert token_set_ratio(a, b) == 100


def test_published_ratio():
    assert indel_ratio("quelto", "quelta") == pytest.approx(100 * (1 - 2 / 12)) and token_set_ratio("B A", "A C B") == 100 and token_set_ratio("", "A") == 0


def test_wilson(spark):
    lo, hi = wilson_interval(F.col("x"), F.col("n"))
    rows = spark.createDataFrame([(8, 10), (0, 0), (10, 10), (0, 5)], "x long, n long").select(lo, hi).collect()
    assert [round(v, 4) for v in rows[0]] == [0.4902, 0.9433] and rows[1][:] == (0.0, 1.0) and rows[2][1] == pytest.approx(1.0) and rows[3][0] == pytest.approx(0.0)


def test_match_quality(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, None)], "p boolean, a boolean")
    r = match_quality(df, F.col("p"), F.col("a")).first()
    assert (r["true_positive"], r["false_positive"], r["false_negative"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    empty = match_quality(df.filter("false"), F.col("p"), F.col("a")).first()
    assert empty["precision"] is None and empty["precision_high"] == 1.0


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert fingerprint(a).first() == fingerprint(a.orderBy(F.desc("k")).select("v", "k")).first() != fingerprint(a.distinct()).first()
    assert spark.createDataFrame([(2.0, 0)], "v double, w int").agg(weighted_mean(F.col("v"), F.col("w"))).first()[0] is None and math.isfinite(1)


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "the Zorvan  Brimsk works"), (2, "quelto lake and quelto"), (3, "Quelto rises"), (4, "unquelto"), (5, None)], "id int, t string")
    rules = [Alias("Z", ("zorvan brimsk",)), Alias("Q", ("quelto",), ("quelto lake",))]
    assert sorted((r["id"], r["entity"]) for r in mentions(texts, "t", rules).collect()) == [(1, "Z"), (3, "Q")]


@pytest.mark.parametrize("values, want", [
    ([1e16, 1.0, -1e16], 1.0), ([0.1] * 10, 1.0), ([None, 2.5, None], 2.5), ([None], None), ([], None),
    ([1e30, 1.0], 1e30), ([9e19] * 3, 2.7e20), ([1.0, math.inf], math.inf), ([1.0, math.nan], math.nan),
])
def test_steady_sum_in_any_order(spark, values, want):
    for order in {tuple(values), tuple(reversed(values)), tuple(sorted(values, key=repr))}:
        got = spark.createDataFrame([(v,) for v in order], "v double").coalesce(1).agg(steady_sum(F.col("v"))).first()[0]
        assert got == want or math.isnan(want) and math.isnan(got), order


def test_round_product_is_that_of_duckdb(spark):
    values = [1.005, 2.675, 49.555, 8.345, 0.125, -0.125, -1.005, 1e300, 12.0, None, *(k / 1000 for k in range(5, 3000, 10))]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(round_product(F.col("v"), 2)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]
