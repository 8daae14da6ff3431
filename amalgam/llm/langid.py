"""Language identification as inference of a mixture.

A document's trigrams of letters are taken as drawn from a mixture of languages. Expectation-maximisation estimates the
mixture's shares from the n-gram likelihoods of all languages; then languages leave while a penalised likelihood (BIC,
``PENALTY`` times the logarithm of the number of trigrams for each language) does not fall. The language with the
largest remaining share is the prediction and that share its score.

The trigram model is learned from documents with a language whose ``crc32(doc_id as text) mod 3`` is not 1. Of these a
bounded sample is used: ``SAMPLE`` documents of each language are expected, chosen by a hash of ``doc_id``. Trigrams
are hashed into ``BUCKETS`` classes, so the model's size is ``BUCKETS`` times the number of languages, and that number has a
bound: labels beyond the ``MAX_LANGUAGES`` most frequent aren't learned. Predictions read whole texts and nothing but the
text. Of languages with equal shares the first by name is predicted.

A null text, or one without a letter (numbers in letter form are none), gets ``und`` with score 0, and so does every text if
nothing could be learned. Rows without ``doc_id`` are not learned from. Empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKETS, SAMPLE, MAX_LANGUAGES = 1 << 15, 4000, 1000
SMOOTHING, PENALTY, LEAST_SHARE, ROUNDS = 0.2, 3.0, 0.02, 100
UNKNOWN = "und"
#: The filter of the pipeline keeps documents whose main language has at least this share.
KEEP_SHARE = 0.25


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points of the basic plane; those that aren't letters become a space."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(1 << 16)), np.uint32, 1 << 16)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of ``text`` and how often each occurs."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(x < 1 << 16, _letters()[x & 0xFFFF], x)
    a, b, c = x[:-2], x[1:-1], x[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[(b != 32) | ((a != 32) & (c != 32))]
    if len(h) < 4000:
        return np.unique(h, return_counts=True)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares and log likelihood. p: by trigram and language; n: counts; share: where to start."""
    total, old = n.sum(), -np.inf
    for _ in range(ROUNDS):
        mix = p @ share
        fit = float(n @ np.log(mix))
        if fit - old < 1e-3:
            break
        old, share = fit, share * ((n / mix) @ p) / total
    return share, fit


def mixture(at: np.ndarray, n: np.ndarray, logp: np.ndarray) -> dict[int, float]:
    """Language index to share. logp: by bucket and language."""
    rows = logp[at]
    single = n @ rows
    best = int(single.argmax())
    if logp.shape[1] == 1:
        return {best: 1.0}
    p = np.exp(rows - rows.max(axis=1, keepdims=True))
    if ((n / p[:, best]) @ p <= n.sum() * (1 + 1e-12)).all():  # the likelihood is concave: no other share can help
        return {best: 1.0}
    share, _ = _em(p, n, np.full(p.shape[1], 1 / p.shape[1]))
    chosen = np.flatnonzero(share >= LEAST_SHARE)
    share, fit = _em(p[:, chosen], n, share[chosen] / share[chosen].sum())
    cost = PENALTY * np.log(n.sum() + 1)
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), share.argmin())
        if len(rest) == 1:
            less, fewer = np.ones(1), float(n @ np.log(p[:, chosen[rest[0]]]))
        else:
            less, fewer = _em(p[:, chosen[rest]], n, share[rest] / share[rest].sum())
        if fit - fewer > cost:
            break
        chosen, share, fit = chosen[rest], less, fewer
    return {int(k): float(s) for k, s in zip(chosen, share)}


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log probabilities by bucket."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    keep = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], float(min(1.0, SAMPLE / r["count"])))))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < keep[F.col("lang")] * (1 << 30)
    sample = labelled.filter(F.col("lang").isin(languages) & chosen).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = trigrams(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": n[at]})

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    got = counts.toPandas()  # at most BUCKETS rows a language
    place = {lang: i for i, lang in enumerate(languages)}
    table[got["bucket"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    return languages, np.log(table / table.sum(axis=0))


def _predict(text: str | None, languages: list[str], logp: np.ndarray) -> tuple[str, float, str]:
    if text is None or not languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, ""
    at, n = trigrams(text)
    if not len(at):
        return UNKNOWN, 0.0, ""
    shares = sorted(((languages[k], s) for k, s in mixture(at, n, logp).items()), key=lambda x: (-x[1], x[0]))
    return shares[0][0], min(1.0, shares[0][1]), ",".join(f"{k}:{s:.2f}" for k, s in shares)


def identify(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the set chosen, with shares) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def predict(batches):
        languages, logp = shared.value
        for batch in batches:
            found = [_predict(t, languages, logp) for t in batch.column(2).to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64()), "languages": pa.array([f[2] for f in found], pa.string()),
            })

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a main language; in the same pass that predicts it."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    place = docs.columns.index("text")

    def keep(batches):
        languages, logp = shared.value
        for batch in batches:
            found = (_predict(t, languages, logp) for t in batch.column(place).to_pylist())
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= KEEP_SHARE for f in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
