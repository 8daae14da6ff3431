"""Benchmark decontamination by the CGK embedding.

Symbols are lower-cased words. The CGK random walk reads a window: at each step it writes the symbol it stands on and
moves on by a random bit that depends on the step and the symbol. Two windows at a small edit distance walk apart at an
edit and are soon together again, so that what they write differs in few steps: edit distance becomes Hamming distance.
Keys made of a few sampled steps are the LSH. Windows start at every word of items and texts, and their size follows the
item's (``CLASSES``): the more edits an item may have, the smaller the part of it that a window can cover and still meet
few of them. Each class walks so often, each time with other bits, that items with as many random edits as are allowed
are candidates with a probability of ``TARGET`` or more (measured in the tests by length). Items of fewer than 5 words
allow no edit and are one window. The exact edit distance between the whole item and the words around a candidate
decides; it compares words, not hashes.

A document is contaminated by an item if some stretch of its words is within ``1 - SIMILARITY`` of the item's length in
word insertions, deletions and replacements. Items without words, and null texts, match nothing. The benchmark is the
query set: it is taken in blocks of ``BLOCK`` items or ``MAX_KEYS`` keys, each one broadcast and run over whole texts of all
documents in one pass; an item of more keys is a block of its own. Repeated items are each reported, rows with a null
``doc_id`` or ``item_id`` like others; repeated rows are each searched. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY, TARGET, BLOCK, MAX_KEYS = 0.8, 0.95, 20_000, 4_000_000
#: Classes of items by their fewest words: words of a window, the steps that are sampled for its key, walks.
CLASSES = (
    (1, 1, (0,), 1), (2, 2, (0, 1, 2, 3), 1), (3, 3, (0, 1, 2, 3, 4, 5), 1), (4, 4, (0, 1, 2, 3, 4, 5, 6, 7), 1),
    (5, 3, (0, 2, 4), 5), (8, 5, (0, 3, 6, 9), 5), (15, 6, (0, 3, 6, 9, 11), 3), (30, 8, (0, 3, 6, 9, 12), 2), (100, 12, (0, 4, 8, 12, 16, 20), 3),
)
STEPS = 1 + max(s for _, _, steps, _ in CLASSES for s in steps)
WALKS = max(c[3] for c in CLASSES)
#: Windows that walk at once, slots of the table that a key must meet before the exact lookup, and words that are counted at once.
CHUNK, SLOTS, CELLS = 1 << 16, 1 << 23, 1 << 22
_WORDS = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def symbols(text: str | None) -> np.ndarray:
    """32-bit hashes of the words; never 0, which stands for what lies behind a window."""
    words = words_of(text)
    joined = map(zlib.crc32, map(str.encode, words))
    return np.maximum(np.fromiter(joined, np.uint32, len(words)), np.uint32(1))


def class_of(n: int) -> int:
    """Index into ``CLASSES`` of an item of n words."""
    return max(c for c, (least, *_) in enumerate(CLASSES) if least <= n)


def _multipliers(walk: int) -> np.ndarray:
    """The random function of one walk: an odd factor for each step, whose product's top bit moves the walk."""
    return np.random.default_rng(1000 + walk).integers(0, 1 << 31, STEPS, np.uint32) * np.uint32(2) + np.uint32(1)


def _keys(padded: np.ndarray, starts: np.ndarray, walk: int, classes: list[int]) -> list[np.ndarray]:
    """By class, a 64-bit key of the window from each start. ``padded`` has ``STEPS`` symbols to spare."""
    factors = _multipliers(walk)
    walked, starts = np.zeros(len(starts), np.int32), starts.astype(np.int32)
    out = [np.full(len(starts), (walk * len(CLASSES) + c + 1) * 0x9E3779B9, np.uint64) for c in classes]
    for step in range(1 + max(max(CLASSES[c][2]) for c in classes)):
        symbol = padded[starts + walked]
        for i, c in enumerate(classes):
            _, size, sampled, _ = CLASSES[c]
            if step in sampled:
                out[i] = (out[i] ^ (symbol if step < size else np.where(walked < size, symbol, np.uint32(0)))) * _M1
                out[i] ^= out[i] >> np.uint64(29)
        walked += ((symbol * factors[step]) >> np.uint32(31)).astype(np.int32)
    return [(k * _M2) ^ (k >> np.uint64(32)) for k in out]


def edits_within(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Fewest word edits between ``item`` and any stretch of ``text``, and the end of the first such stretch; None if more
    than ``most``. Myers' bit-parallel recurrence, with Python's integers as words of any length."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        same = (((eq & up) + up) ^ up) | eq
        plus = down | (~(same | up) & full)
        minus = up & same
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best[0]:
            best = (score, j + 1)
        plus = (plus << 1) & full  # a stretch may begin anywhere: no 1 is shifted in
        minus = (minus << 1) & full
        up = minus | (~(x | plus) & full)
        down = plus & x
    return best if best[0] <= most else None


class Index:
    """The keys of a block of items, and their words for the exact check."""

    def __init__(self, items: list[tuple[int, str]]):
        known = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids, self.words = [i for i, _ in known], [w for _, w in known]
        self.symbols = [symbols(" ".join(w)) for w in self.words]
        self.sorted = [np.unique(x) for x in self.symbols]
        of = [class_of(len(w)) for w in self.words]
        self.classes = sorted(set(of))
        keys, owners, offsets = [], [], []
        for t, (x, c) in enumerate(zip(self.symbols, of)):
            starts = np.arange(len(x) - CLASSES[c][1] + 1)  # windows that the item fills
            padded = np.concatenate([x, np.zeros(STEPS + 1, np.uint32)])
            for walk in range(CLASSES[c][3]):
                keys += _keys(padded, starts, walk, [c])
                owners.append(np.full(len(starts), t))
                offsets.append(starts)
        flat = lambda v, kind: np.concatenate(v).astype(kind) if v else np.zeros(0, kind)
        key, owner, offset = flat(keys, np.uint64), flat(owners, np.int64), flat(offsets, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.offset = key[order], owner[order], offset[order]
        self.slots = np.zeros(SLOTS, bool)
        self.slots[self.key % np.uint64(SLOTS)] = True

    def allowed(self, t: int) -> int:
        return int((1 - SIMILARITY) * len(self.words[t]) + 1e-9)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Rows (item number, position at which the item would start), each once. ``x``: the symbols of several texts with
        gaps of zeros."""
        padded = np.concatenate([x, np.zeros(STEPS + 1, np.uint32)])
        found = []
        starts = np.flatnonzero(x)
        for at in range(0, len(starts), CHUNK):
            some = starts[at : at + CHUNK]
            for walk in range(WALKS):
                classes = [c for c in self.classes if walk < CLASSES[c][3]]
                for k in _keys(padded, some, walk, classes) if classes else ():
                    hit = np.flatnonzero(self.slots[k % np.uint64(SLOTS)])
                    if len(hit):
                        low, high = np.searchsorted(self.key, k[hit], "left"), np.searchsorted(self.key, k[hit], "right")
                        n = high - low
                        row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        found.append(self.owner[row] << 40 | (np.repeat(some[hit], n) - self.offset[row] + (1 << 39)))
        flat = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([flat >> 40, (flat & (1 << 40) - 1) - (1 << 39)], axis=1)

    def plausible(self, x: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates around which so many words are the item's as no edit may touch."""
        keep = []
        for t in np.unique(found[:, 0]).tolist():
            mine = found[found[:, 0] == t]
            n, most = len(self.words[t]), self.allowed(t)
            span = np.arange(-2 * most, n + 2 * most)
            for at in range(0, len(mine), max(1, CELLS // len(span))):
                some = mine[at : at + max(1, CELLS // len(span))]
                place = some[:, 1, None] + span
                near = np.where((place >= 0) & (place < len(x)), x[np.clip(place, 0, len(x) - 1)], np.uint32(0))
                order = self.sorted[t]
                inside = order[np.minimum(np.searchsorted(order, near), len(order) - 1)] == near
                keep.append(some[inside.sum(axis=1) >= n - most])
        return np.concatenate(keep) if keep else found

    def hits(self, words: list[str], candidates: np.ndarray) -> dict[int, tuple[int, int]]:
        """Item number to (edits, end) of the best stretch of a text, given as words."""
        best: dict[int, tuple[int, int]] = {}
        for t, start in candidates.tolist():
            n, most = len(self.words[t]), self.allowed(t)
            if best.get(t, (n,))[0] == 0:
                continue
            low, high = max(0, start - 2 * most), min(len(words), start + n + 2 * most)
            got = edits_within(self.words[t], words[low:high], most)
            if got and got[0] < best.get(t, (n + 1,))[0]:
                best[t] = (got[0], low + got[1])
        return best


def _search(index: Index, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
    """The hits of each text. Texts are searched together, as one long string of symbols with gaps."""
    gap = np.zeros(STEPS + 1, np.uint32)
    parts, begins, at = [], [], 0
    for t in texts:
        x = symbols(t)
        begins.append(at)
        parts += [x, gap]
        at += len(x) + len(gap)
    if not parts or not len(index.key):
        return [{} for _ in texts]
    x, begins = np.concatenate(parts), np.asarray(begins)
    found = index.plausible(x, index.candidates(x))
    # by the text in which the middle of the item would be: its start may lie before the text
    middle = found[:, 1] + np.array([len(w) // 2 for w in index.words])[found[:, 0]]
    text = np.clip(np.searchsorted(begins, middle, "right") - 1, 0, len(texts) - 1)
    out: list[dict] = [{} for _ in texts]
    for d in np.unique(text):
        mine = found[text == d]
        out[d] = index.hits(words_of(texts[d]), mine - [0, begins[d]])
    return out


def _batches(texts: list, chars: int = 1 << 20):
    """Index ranges of texts of about so many characters."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _blocks(benchmark: DataFrame, block: int = BLOCK):
    """Indexes of the items in blocks."""
    held, keys = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        n = len(words_of(r[1]))
        if not n:
            continue
        more = n * CLASSES[class_of(n)][3]
        if held and (len(held) == block or keys + more > MAX_KEYS):
            yield Index(held)
            held, keys = [], 0
        held.append((r[0], r[1]))
        keys += more
    if held:
        yield Index(held)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, end_word (behind the last word of the stretch), item_words, similarity: a row for each row of
    ``docs`` and item that it holds."""
    spark = docs.sparkSession
    kind, item = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item}, edits int, end_word int, item_words int, similarity double"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for low, high in _batches(texts):
                    rows = []
                    for d, hits in zip(ids[low:high], _search(index, texts[low:high])):
                        for t, (edits, end) in sorted(hits.items()):
                            n = len(index.words[t])
                            rows.append((d, index.ids[t], edits, end, n, 1 - edits / n))
                    columns = list(zip(*rows)) or [()] * 6
                    kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    names = ("doc_id", "item_id", "edits", "end_word", "item_words", "similarity")
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(search, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item; filtered in the pass that searches them, without a shuffle."""
    place = docs.columns.index("text")
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            index = shared.value
            for batch in batches:
                texts = batch.column(place).to_pylist()
                clean = [not hits for low, high in _batches(texts) for hits in _search(index, texts[low:high])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
