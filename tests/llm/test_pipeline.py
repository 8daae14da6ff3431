"""The pipeline against a brute-force version of its stages."""

import math
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_near_copies import brute_sets, jaccard  # noqa: E402

from amalgam.llm import decontaminate, langid, mixing  # noqa: E402
from amalgam.llm.common import documents  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    kept = {i for i, r in rows.items() if (p := langid._predict(r["text"], *model))[0] != "und" and p[1] >= langid.KEEP_SHARE}
    first: dict = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"] or ""), i)
    kept = set(first.values())
    sets = {i: brute_sets(rows[i]["text"]) for i in sorted(kept)}
    label = {i: i for i in sets}
    with_shingle: dict = {}
    for i, found in sets.items():
        for x in found:
            with_shingle.setdefault(x, []).append(i)
    for i, j in {(i, j) for ids in with_shingle.values() for i in ids for j in ids if i < j}:
        if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = {k: low if x == high else x for k, x in label.items()}
    assert len(set(label.values())) < len(kept)
    kept = set(label.values())
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i in kept if any(plain(t) in plain(rows[i]["text"]) for t in items)}
    index = decontaminate.Index(list(enumerate(items)))
    assert dirty <= {i for i in kept if decontaminate._search(index, [rows[i]["text"]])[0]}
    kept = {i for i in kept if not decontaminate._search(index, [rows[i]["text"]])[0]}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"])) for i in kept}

    out = corpus_pipeline.run(spark, SF).collect()
    taken: dict = {}
    for r in out:
        assert r["text"] == rows[r["doc_id"]]["text"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["take_words"]
    # every row that the earlier stages keep is placed as by the plan of exactly those rows
    plan = mixing.plan_mix(docs.filter(F.col("doc_id").isin(*kept))).collect()
    assert {r["doc_id"] for r in plan} == kept and {r["doc_id"]: r["taken"] for r in plan if r["taken"]} == taken
    assert all(r["size"] == size[r["doc_id"]] for r in plan) and math.isclose(sum(taken.values()), 1.5 * sum(size.values()), abs_tol=9)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_stages_return_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
