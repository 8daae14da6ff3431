"""Similarity of names: one Python boundary, in Arrow batches of pairs."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns in Python's integers."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 less the share of insertions and deletions that turn one string into the other."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's rest; 100 if one side's words hold the other's."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    la, lb, ls = " ".join(sorted(left - right)), " ".join(sorted(right - left)), len(" ".join(sorted(shared)))
    gap = bool(ls)
    whole_a, whole_b = ls + gap + len(la), ls + gap + len(lb)
    edits = len(la) + len(lb) - 2 * common_subsequence(la, lb)
    best = 100.0 * (1 - edits / (whole_a + whole_b))
    if shared:
        best = max(best, 100.0 * (1 - (gap + len(la)) / (ls + whole_a)), 100.0 * (1 - (gap + len(lb)) / (ls + whole_b)))
    return best


def written(variants: Column) -> Column:
    """Variants of a name, an array of (bare, tokens, telling), as one text: the form in which they cross to Python."""
    return F.array_join(F.transform(variants, lambda v: F.concat(v["bare"], F.lit("\t"), v["tokens"], F.lit("\t"), v["telling"].cast("string"))), "\n")


@lru_cache(1 << 16)
def _read(text: str) -> list[tuple[str, str, bool]]:
    return [(bare, tokens, telling == "true") for bare, tokens, telling in (line.split("\t") for line in text.split("\n") if line)]


def best_similarity(left: str, right: str) -> float:
    """Best over pairs of variants of the ratio of bare names and, if both sides' tokens identify, that of token sets."""
    best = 0.0
    for bare_a, tokens_a, telling_a in _read(left):
        for bare_b, tokens_b, telling_b in _read(right):
            best = max(best, indel_ratio(bare_a, bare_b))
            if telling_a and telling_b and best < 100:
                best = max(best, token_set_ratio(tokens_a, tokens_b))
    return best


def name_similarity(left: Column, right: Column) -> Column:
    """0 to 100 for two columns of written variants."""

    @F.arrow_udf("double")
    def best(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([best_similarity(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return best(left, right)
