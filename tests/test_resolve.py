import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from amalgam.operators import quality as Q
from amalgam.operators.graph import component_of, components
from amalgam.resolve import entities as E
from amalgam.resolve import pairs as P
from amalgam.resolve.records import RECORD, inherit_countries, prepare


def record(source, ident, names, countries=(), city=None, leis=(), ciks=(), tickers=(), domains=(), firm=None, **attributes):
    return (f"{source}:{ident}", source, ident, list(names), list(countries), city, list(leis), (source == "gleif") if firm is None else firm, list(ciks), list(tickers), list(domains), {k: str(v) for k, v in attributes.items()})


def frame(spark, records):
    return spark.createDataFrame(records, RECORD)


#: Other records, so that words have the frequencies of a real universe.
FILLER = [record("opensanctions", f"f{i}", [f"FILLER{i} WORD{i}"]) for i in range(300)]


@pytest.fixture(scope="module")
def run(spark):
    records = [
        record("gleif", "A" * 18 + "11", ["PAMPA ENERGIA S.A."], ["AR"], "BUENOS AIRES", ["A" * 18 + "11"], legal_form="SA", entity_status="ACTIVE"),
        record("sec_edgar", "1", ["Pampa Energy Inc."], ["AR"], "BUENOS AIRES", ciks=[1], tickers=["PAM"], website="pampa.com"),
        record("wikidata", "Q1", ["Pampa Energía"], ["AR"], ciks=[1], tickers=["PAM"]),
        record("gdelt", "PAM", ["Pampa Energia"], ciks=[1]),
        record("gleif", "B" * 18 + "22", ["BANCO MACRO S.A."], ["AR"], "SALTA", ["B" * 18 + "22"]),
        record("opensanctions", "os1", ["Macro Bank Inc", "Banco Macro"], ["AR"], leis=["B" * 18 + "22"], sanctioned="true"),
        record("gleif", "B" * 18 + "33", ["BANCO MACRO S.A."], ["AR"], "SALTA", ["B" * 18 + "33"], firm=False),
        record("gleif", "C" * 18 + "44", ["FONDO OPTIMUM SERIE 1 FCI"], ["AR"], leis=["C" * 18 + "44"]),
        record("sec_edgar", "9", ["Optimum Serie 2"], ["US"], ciks=[9]),
    ] + FILLER
    return E.resolve(frame(spark, records)) | {"records": frame(spark, records)}


def test_decisions(run):
    got = {(r["key_a"].split(":")[0] + r["key_a"][-2:], r["key_b"].split(":")[0] + r["key_b"][-2:]): r for r in run["decided"].collect()}
    pampa = next(r for k, r in got.items() if k == ("gleif11", "sec_edgar:1"))
    assert pampa["decision"] == "accepted" and pampa["points"]["name"] == 60 and pampa["points"]["country"] == 10 and pampa["score"] == 75
    assert next(r for k, r in got.items() if k[0] == "gdeltAM" and k[1] == "sec_edgar:1")["decision"] == "deterministic"
    hint = next(r for k, r in got.items() if k == ("sec_edgar:1", "wikidataQ1"))
    assert hint["points"]["hint_id"] == 40 and hint["decision"] == "accepted" and hint["shared_id"] is None
    twin = next(r for k, r in got.items() if k == ("gleif22", "gleif33"))
    assert twin["points"]["twin_lei"] == 30


def test_entities(run):
    entity = {r["key"]: r["entity_id"] for r in run["membership"].collect()}
    lei = lambda c, n: f"gleif:{c * 18}{n}"
    assert len({entity[k] for k in (lei("A", 11), "sec_edgar:1", "wikidata:Q1", "gdelt:PAM")}) == 1
    assert entity[lei("B", 22)] == entity["opensanctions:os1"] == entity[lei("B", 33)] != entity[lei("A", 11)]
    assert entity[lei("C", 44)] != entity["sec_edgar:9"] and len(entity) == 309


def test_golden(run):
    import hashlib

    g = {r["lei"]: r for r in run["golden"].collect()}
    pampa = g["A" * 18 + "11"]
    assert pampa["entity_id"] == "E" + hashlib.sha1(f"gleif:{'A' * 18}11".encode()).hexdigest()[:12].upper()
    assert (pampa["name"], pampa["cik"], pampa["ticker"], pampa["website"], pampa["records"], pampa["sanctioned"]) == ("PAMPA ENERGIA S.A.", "1", "PAM", "pampa.com", 4, False)
    assert pampa["provenance"]["name"].startswith("gleif:") and pampa["provenance"]["cik"] == "sec_edgar:1" and pampa["sources"] == ["gdelt", "gleif", "sec_edgar", "wikidata"]
    macro = g["B" * 18 + "22"]
    assert macro["sanctioned"] and macro["on_risk_lists"] and macro["register_duplicates"] == 1


def test_integrity(run):
    assert {r["failed"] for r in E.integrity(run["prepared"], run["membership"], run["golden"], run["decided"], run["review"]).collect()} == {0}


def test_inherited_countries(spark):
    records = [record("gdelt", "x", ["X"], ciks=[5]), record("sec_edgar", "5", ["X"], ["AR", "US"], ciks=[5]), record("wikidata", "Q", ["X"], ["FR"], ciks=[5]), record("gdelt", "y", ["Y"])]
    got = {r["key"]: (r["countries"], r["inherited_from"]) for r in inherit_countries(frame(spark, records)).collect()}
    assert got["gdelt:x"] == (["AR", "US"], ["sec_edgar:5"]) and got["gdelt:y"] == ([], None) and got["sec_edgar:5"] == (["AR", "US"], None)


def test_ids_are_stable(spark):
    members = spark.createDataFrame([("gleif:a", "r1"), ("gleif:b", "r1"), ("gleif:c", "r2"), ("gleif:d", "r3")], "key string, cluster string")
    prepared = spark.createDataFrame([(f"gleif:{k}", "gleif", True) for k in "abcd"], "key string, source string, lei_firm boolean")
    previous = spark.createDataFrame([("gleif:a", "E1"), ("gleif:b", "E1"), ("gleif:c", "E1")], "key string, entity_id string")
    got = {r["cluster"]: r["entity_id"] for r in E.entity_ids(members, prepared, previous).collect()}
    assert got["r1"] == "E1" and got["r2"] != "E1" and len(set(got.values())) == 3
    taken = spark.createDataFrame([("gone:1", got["r3"])], "key string, entity_id string")
    assert {r["cluster"]: r["entity_id"] for r in E.entity_ids(members, prepared, taken).collect()}["r3"] == got["r3"] + "-2"


def test_ties_are_reviewed(spark):
    decided = spark.createDataFrame([("a", "x", 80, "accepted"), ("a", "y", 80, "accepted"), ("b", "x", 90, "accepted"), ("b", "y", 70, "accepted")], "key_a string, key_b string, score int, decision string")
    prepared = spark.createDataFrame([("a", []), ("b", []), ("x", ["L1"]), ("y", ["L2"])], "key string, firm_leis array<string>")
    assert sorted(tuple(r) for r in P.ties(decided, prepared).collect()) == [("a", "x"), ("a", "y")]


@pytest.mark.parametrize("seed", range(40))
def test_component_pass_is_the_global_pass(seed):
    """The ordered joins inside each component give what one pass over all pairs gives."""
    rng = random.Random(seed)
    keys = [f"k{i:02d}" for i in range(24)]
    lei = {k: [rng.choice("ABC")] if rng.random() < 0.4 else [] for k in keys}
    pairs = sorted({tuple(sorted(rng.sample(keys, 2))) for _ in range(20)})
    rows = [(a, b, rng.randrange(2), rng.randrange(70, 75), lei[a], [], lei[b], []) for a, b in pairs]
    edges = pd.DataFrame(rows, columns=["key_a", "key_b", "rank", "score", "leis_a", "ciks_a", "leis_b", "ciks_b"])
    seen, groups = {}, []
    for a, b in pairs:
        group = {a, b}.union(*(g for g in groups if g & {a, b}))
        groups = [g for g in groups if not g & {a, b}] + [group]
    split = pd.concat([E.join_in_order(edges[edges.key_a.isin(g)]) for g in groups])
    whole = E.join_in_order(edges)
    as_set = lambda d: {tuple(r) for r in d.where(d.notna(), None).itertuples(index=False)}
    assert as_set(split) == as_set(whole) and not seen


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for p in pairs for x in p} | {999: 999}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame(pairs, "a int, b int")
    nodes = spark.createDataFrame([(x,) for x in parent], "n int")
    assert {r["n"]: r["component"] for r in component_of(nodes, df, "n", "a", "b").collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "node int, lower int")).count() == 0


def test_block_limits_and_grid(spark):
    same = [record("gleif", f"{i}", ["COMMON NAME"], ["AR"], leis=[f"L{i}"]) for i in range(4)] + [record("sec_edgar", "s", ["COMMON NAME"], ["AR"], ciks=[1])]
    prepared = prepare(frame(spark, same + FILLER[:40]))
    assert P.candidate_pairs(prepared).count() == 4 and P.candidate_pairs(prepared, block_size=4).count() == 0
    assert P.block_report(prepared, block_size=4).first()["too_large"] == 4  # two words, their prefix, and the fillers' prefix
    pairs = P.candidate_pairs(prepared).select("key_a", "key_b")
    truth = pairs.withColumn("match", F.col("key_a") == "gleif:0")
    best = P.grid(P.signals(pairs, prepared), truth, {"name": [10, 60], "accept": [70, 200]}).first()
    assert (best["w_name"], best["w_accept"], best["true_positive"], best["false_positive"]) == (60.0, 70.0, 1, 3)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", None), (None, "a", 500)], "k int, v string, n int")
    checks = [Q.not_missing("k"), Q.unique(["k", "v"]), Q.within("n", 0, 100, critical=False), Q.has_columns(["k", "z"], critical=False), Q.accepted("v", ["a", "b"]), Q.not_missing("gone"), Q.row_count(1, 3), Q.fresh("n", F.lit(None), 1)]
    got = {r["check"]: (r["failed"], r["outcome"]) for r in Q.run_checks(df, checks).collect()}
    assert got == {"missing k": (1, "fail"), "unique k, v": (0, "pass"), "range n": (1, "warn"), "schema": (1, "warn"), "values v": (0, "pass"), "missing gone": (None, "not evaluated"), "row count": (0, "pass"), "fresh n": (1, "warn")}
    v = Q.verdict(Q.run_checks(df, checks)).first()
    assert v["state"] == "quarantined" and v["critical_failures"] == ["missing gone", "missing k"] and v["warnings"] == ["fresh n", "range n", "schema"]
    assert Q.verdict(Q.run_checks(df.filter("false"), [Q.not_missing("k"), Q.unique(["k"])])).first()["state"] == "approved"


def test_words_of_large_universes_stay_rare(spark, monkeypatch):
    """Words above the bound of frequent ones, in a universe where the rule calls them rare."""
    monkeypatch.setattr("amalgam.resolve.records.FREQUENT", 1)
    records = [record("opensanctions", f"r{i}", ["ZYXW" if i < 3 else f"FILLER{i} COMMON"]) for i in range(1000)]
    got = {r["key"]: r for r in prepare(frame(spark, records)).select("key", "rare_tokens", "variants").filter("source_id in ('r0', 'r5')").collect()}
    assert got["opensanctions:r0"]["rare_tokens"] == ["ZYXW"] and got["opensanctions:r0"]["variants"][0]["telling"]
    assert got["opensanctions:r5"]["rare_tokens"] == ["FILLER5"]
