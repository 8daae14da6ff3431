"""Every operator on the tables' hard cases: no rows, nulls in any column, empty and very long texts, ties and repeated rows,
extra columns with clashing names."""

import pytest
from oracle import differences
from pyspark.sql import functions as F

from amalgam.llm import chat, decontaminate, exact_dedup, html_text, langid, lm_score, mixing, near_copies, oracles, queries, secret_scan, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the of and in to a is it was for " * 20_000
ROWS = [
    (1, "the cat  sat on\tthe mat", "en", "a", 1), (2, "the cat sat on the mat", "en", "a", 1), (2, "the cat sat on the mat", "en", "a", 1), (None, "the cat sat on the mat", None, None, None),
    (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \n", None, "b", 0), (None, None, None, None, None), (6, LONG, "en", "c", 1), (7, "12 34 !!", "en", "c", 1),
    (8, "el gato se sienta en la alfombra roja", "es", "c", 1), (9, "el perro se sienta en la calle larga", "es", "é", 1), (9, "el perro se sienta en la calle larga", "es", "é", 1),
]
CLASHES = ("score", "size", "kept", "keep_id", "row", "winner", "group_size", "text_sha256", "epoch", "position", "fp", "component_id", "held_out", "target", "known", "h", "bucket", "start", "rank", "token", "spans", "base")

DOC_OPS = {
    "langid": langid.identify, "exact": exact_dedup.duplicate_groups, "mixing": mixing.plan_mix, "simhash": simhash.near_duplicates, "lm": lm_score.score, "secrets": lambda d: secret_scan.digest(secret_scan.scan(d)),
    "decontaminate": lambda d: decontaminate.contaminations(d, d.sparkSession.createDataFrame([(1, "cat sat on the mat"), (2, None), (3, ""), (1, "cat sat on the mat")], "item_id long, text string")),
}
FILTERS = {
    "keep_identified": langid.keep_identified, "keep_first": exact_dedup.keep_first, "keep_one": simhash.keep_one, "keep_near": near_copies.keep_one, "curriculum": mixing.curriculum,
    "keep_clean": lambda d: decontaminate.keep_clean(d, d.sparkSession.createDataFrame([(1, "gato se sienta en la alfombra")], "item_id long, text string")),
}


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(spark, queries.queries()[name], oracles.ORACLES[name], sf) == ""


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", [n for n in DOC_OPS if n != "decontaminate"])
def test_a_row_for_each_row(spark, name):
    out = DOC_OPS[name](docs(spark))
    assert sorted(map(repr, (r["doc_id"] for r in out.select("doc_id").collect()))) == sorted(repr(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", DOC_OPS)
def test_no_rows(spark, name):
    assert DOC_OPS[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", DOC_OPS)
def test_clashing_columns_and_reruns(spark, name):
    assert rows(DOC_OPS[name](clashing(docs(spark)))) == rows(DOC_OPS[name](docs(spark)))


@pytest.mark.parametrize("name", FILTERS)
def test_filters(spark, name):
    d = clashing(docs(spark))
    out = FILTERS[name](d)
    assert set(out.columns) >= set(docs(spark).columns) and FILTERS[name](docs(spark, [])).count() == 0
    if name != "curriculum":
        assert out.columns == d.columns and set(rows(out)) <= set(rows(d))


def test_filters_decide(spark):
    ids = lambda name: sorted(map(repr, (r["doc_id"] for r in FILTERS[name](docs(spark)).collect())))
    assert ids("keep_first") == sorted(map(repr, [1, 3, 5, 6, 7, 8, 9]))
    assert "8" not in ids("keep_clean") and len(ids("keep_clean")) == len(ROWS) - 1
    assert "3" not in ids("keep_identified") and "7" not in ids("keep_identified") and "1" in ids("keep_identified")
    assert ids("keep_one") == sorted(map(repr, [1, 3, 6, 7, 8, 9])) == ids("keep_near")


def test_pages_and_conversations(spark):
    pages = "page_id long, url string, html string"
    p = spark.createDataFrame([(1, None, None), (1, "", ""), (None, "http://x.com/", "<p>x"), (2, "x", "<table" * 1000)], pages)
    assert html_text.extract(p).count() == 4 == url_filter.judge(clashing(p)).count()
    assert html_text.extract(p.filter("false")).count() == 0 == url_filter.judge(p.filter("false")).count()
    conv = "conv_id long, turn long, role string, text string"
    c = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", None), (1, 0, None, "x"), (None, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "")], conv)
    c = c.unionByName(c.filter("conv_id IS NULL"))
    alone = [r for r in chat.digests(chat.format_conversations(clashing(c))).collect() if r["conv_id"] is None]
    assert [r["n_turns"] for r in alone] == [1, 1]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(clashing(c))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 2, None: 1} and got[2]["loss_chars"] == 0
    assert chat.format_conversations(c.filter("false")).count() == 0
