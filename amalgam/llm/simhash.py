"""SimHash near-duplicates by bit-sliced comparison.

A-Z is lower-cased, words are runs without white space, and each 3-word shingle, repeats included, votes with its XXH64
(seed 42) on 64 bits; a bit is 1 if more than half set it. Fewer words: the whole sequence is the one shingle; no words:
fingerprint zero. Fingerprints that differ in 3 bits or fewer are linked.

Two such fingerprints agree on at least 2 of 5 parts of the bits, so the ten pairs of parts deal every fingerprint into
ten tables, where linked ones meet under a key of about 26 bits. Only different fingerprints are dealt: copies of one are
one row. Within a partition sorted by key the 64 bits of the rows lie vertically, one plane of packed words for each bit.
A row meets 64 others at once: the planes that differ from its own bits are added with carry-save counters, and a block
of 64 is abandoned once all its counters have passed the radius. Links are merged where they are found, so a block of n
fingerprints gives at most n - 1 edges, not n^2.

A run of more than ``LONGEST_RUN`` fingerprints under one key isn't compared there: its rows are dealt anew by the 56
choices of 5 of 8 parts, and what is still too long by the 560 choices of 13 of 16, on which linked fingerprints agree too,
so no link is lost to a hot key. The last keys leave 12 bits free, so no run there has more than 4096 fingerprints.

Components come from the edges by hooking and shortcutting until none changes, each round written to the shared folder;
no edge or fingerprint goes to the driver.

Null text counts as empty. Rows with a null ``doc_id`` take part; a component of only such rows has a null id. Rows that
share a ``doc_id`` are each listed. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialize

WORDS, SEED, RADIUS = 3, 42, 3
LONGEST_RUN = 1 << 16
#: Rows and words of 64 that meet in one step; bounds the memory of the comparison.
STEP = 1 << 16
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _parts(n: int) -> list[int]:
    """Masks of n nearly equal parts of 64 bits."""
    ends = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(ends, ends[1:])]


def key_masks(parts: int, agree: int) -> list[int]:
    """Masks of the choices of ``agree`` of ``parts``; fingerprints with parts - agree differing bits share one."""
    return [sum(c) for c in combinations(_parts(parts), agree)]


#: From coarse to fine; each takes what was too long in the one before.
TABLES = (key_masks(5, 2), key_masks(8, 5), key_masks(16, 13))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        votes += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def prints(batches):
        for batch in batches:
            got = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": got.view(np.int64)})

    return docs.select("doc_id", "text").mapInArrow(prints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """By bit, words of 64 rows: bit j of word w of plane b is bit b of row 64 w + j."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def near(fp: np.ndarray, ends: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j, bits), i < j < ends[i], of the rows whose fingerprints differ in at most ``radius`` bits, and in how
    many. ``fp``: a word of 64 bits a row, or several."""
    fp = fp[:, None] if fp.ndim == 1 else fp
    planes, n, digits = [p for k in range(fp.shape[1]) for p in _planes(fp[:, k])], len(fp), max(radius.bit_length(), 1)
    start = (1 << digits) - 1 - radius  # from here a counter overflows at radius + 1
    rows = np.arange(n)
    first, count = rows // 64, np.where(ends > rows + 1, (ends - 1) // 64 - rows // 64 + 1, 0)
    total = np.cumsum(count)
    for at in range(0, int(total[-1]) if n else 0, STEP):
        task = np.arange(at, min(at + STEP, int(total[-1])))
        row = np.searchsorted(total, task, side="right")
        word = first[row] + task - (total[row] - count[row])
        # lanes that aren't a later row of the run count as beyond the radius from the start
        low, high = np.clip(row + 1 - 64 * word, 0, 64), np.clip(ends[row] - 64 * word, 0, 64)
        upto = lambda k: np.where(k >= 64, _ALL, (_ONE << np.minimum(k, 63).astype(np.uint64)) - _ONE)
        over = ~(upto(high) & ~upto(low))
        counter = [np.full(len(row), _ALL if start >> d & 1 else np.uint64(0)) for d in range(digits)]
        for b in range(0, len(planes), 4):
            own = fp[row, b // 64]
            for k in range(b, b + 4, 2):  # a carry-save adder takes two planes and the ones
                x = planes[k][word] ^ (np.uint64(0) - ((own >> np.uint64(k % 64)) & _ONE))
                y = planes[k + 1][word] ^ (np.uint64(0) - ((own >> np.uint64(k % 64 + 1)) & _ONE))
                xy = x ^ y
                carry = (x & y) | (xy & counter[0])
                counter[0] ^= xy
                for d in range(1, digits):
                    counter[d], carry = counter[d] ^ carry, counter[d] & carry
                over |= carry
            alive = over != _ALL
            if not alive.all():
                row, word, over, *counter = (v[alive] for v in (row, word, over, *counter))
                if not len(row):
                    break
        if len(row):
            lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(lanes)
            bits = sum((c[t] >> lane.astype(np.uint64) & _ONE).astype(np.int64) << d for d, c in enumerate(counter)) - start
            yield row[t], word[t] * 64 + lane, bits


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; label holds for each row a smaller one of its set, at a fixed point the smallest."""
    while len(i):
        a, b = label[i], label[j]
        while ((a2 := label[a]) != a).any():
            a = a2
        while ((b2 := label[b]) != b).any():
            b = b2
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def forests(label: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray, times: int) -> np.ndarray:
    """Which of the pairs are in a minimum spanning forest by ``bits`` of the sets in ``label``, or in one of those without
    the pairs of the forests before it, up to ``times``."""
    order = np.argsort(bits, kind="stable")
    chosen: list[np.ndarray] = []
    for _ in range(times):
        own, left, taken = label.copy(), order, []
        for at in np.split(left, np.flatnonzero(np.diff(bits[left])) + 1):
            while len(at):
                while ((deeper := own[own]) != own).any():
                    own = deeper
                a, b = own[i[at]], own[j[at]]
                at, a, b = at[a != b], a[a != b], b[a != b]
                first = np.unique(np.maximum(a, b), return_index=True)[1]  # each set takes one pair to a lower one
                taken.append(at[first])
                _merge(own, i[at[first]], j[at[first]])
        chosen += taken
        order = np.setdiff1d(order, np.concatenate([*taken, np.zeros(0, np.int64)]), assume_unique=True)
        order = order[np.argsort(bits[order], kind="stable")]
    return np.sort(np.concatenate([*chosen, np.zeros(0, np.int64)])).astype(np.int64)


def _edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Edges (fp, lower) that hold together what is linked among sorted rows."""
    label = np.arange(len(fp))
    for i, j, _ in near(fp, run_ends(key)):
        _merge(label, i, j)
    while ((deeper := label[label]) != label).any():
        label = deeper
    moved = np.flatnonzero(label != np.arange(len(label)))
    a, b = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
    return pa.record_batch({"fp": np.maximum(a, b), "lower": np.minimum(a, b)})


def sorted_runs(batches, columns: int, step: int = STEP):
    """Of batches whose first column is a sorted key, stretches of whole runs of ``step`` rows or more: arrays of the columns,
    each as 64-bit words. A run is held whole."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in range(columns)])
        n += batch.num_rows
        if n >= step:
            flat = [np.concatenate(c) for c in zip(*held)]
            last = int(np.searchsorted(flat[0].view(np.int64), flat[0].view(np.int64)[-1], side="left"))
            if last:
                yield [c[:last] for c in flat]
            held, n = [[c[last:] for c in flat]], len(flat[0]) - last
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def run_ends(key: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, where its run ends."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))


def _compare(longest: int):
    """Turns rows (key, fp) sorted by key into edges; the rows of longer runs come back as edges to null."""

    def run(batches):
        keys, fps, long_key = [], [], None
        held = 0

        def flush(upto: int):
            nonlocal keys, fps, held
            key, fp = np.concatenate(keys), np.concatenate(fps)
            keys, fps, held = [key[upto:]], [fp[upto:]], len(key) - upto
            return _edges(key[:upto], fp[:upto])

        def overflow(fp):
            return pa.record_batch({"fp": pa.array(fp.view(np.int64)), "lower": pa.nulls(len(fp), pa.int64())})

        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            fp = fp.view(np.uint64)
            if long_key is not None:
                same = int(np.searchsorted(key, long_key, side="right"))
                if same:
                    yield overflow(fp[:same])
                if same == len(key):
                    continue
                key, fp, long_key = key[same:], fp[same:], None
            keys.append(key)
            fps.append(fp)
            held += len(key)
            if held > longest:
                flat = np.concatenate(keys)
                last = int(np.searchsorted(flat, flat[-1], side="left"))
                starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                sizes = np.diff(np.append(starts, len(flat)))
                if (sizes > longest).any():
                    allfp = np.concatenate(fps)
                    hot = np.repeat(sizes > longest, sizes)
                    yield overflow(allfp[hot])
                    if hot[-1]:
                        long_key = flat[-1]
                        keys, fps, held = [flat[~hot]], [allfp[~hot]], int((~hot).sum())
                        if held:
                            yield flush(held)
                        continue
                    keys, fps = [flat[~hot]], [allfp[~hot]]
                    held = int((~hot).sum())
                    last = int(np.searchsorted(keys[0], flat[-1], side="left"))
                if last:
                    yield flush(last)
        if held:
            yield flush(held)

    return run


def _deal(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (key, fp): each fingerprint once for each mask, dealt by key and sorted within partitions."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed))))
    return fps.select(tables.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")


def links(fps: DataFrame, longest: int | None = None) -> DataFrame:
    """Edges (fp, lower) between different fingerprints whose components are those of all links. ``fps``: distinct fp."""
    edges = None
    for masks in TABLES:
        most = (longest or LONGEST_RUN) if masks is not TABLES[-1] else 1 << 62
        found = materialize(_deal(fps, masks).mapInArrow(_compare(most), "fp long, lower long"), "links")
        there = found.filter("lower IS NOT NULL")
        edges = edges.unionByName(there) if edges else there
        fps = found.filter("lower IS NULL").select("fp").distinct()
        if fps.isEmpty():
            break
    return edges.distinct()


def _classes(prints: DataFrame, place) -> DataFrame:
    """fp, and the least ``place`` in its component (least), for each different fingerprint. ``prints``: a table with fp."""
    classes = materialize(prints.groupBy("fp").agg(F.min(place).alias("first")), "classes")
    lowest = components(links(classes.select("fp")), "fp").withColumnRenamed("fp", "node")
    rooted = materialize(classes.join(lowest, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("lowest", "fp").alias("root")), "roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("least")), "smallest").withColumnRenamed("root", "of")
    return rooted.join(smallest, F.col("root") == F.col("of")).select("fp", "root", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of each row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    ids = materialize(_classes(prints, F.col("doc_id")).select(F.col("fp").alias("class"), F.col("least").alias("component_id")), "ids")
    return prints.join(ids, F.col("fp") == F.col("class")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that come first by doc_id (nulls last) in their component: one of each, whatever ids its
    rows have or share."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    prints = fingerprints(rows.select(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "__row").alias("doc_id"), "text"))
    first = _classes(materialize(prints.withColumnRenamed("doc_id", "place"), "fingerprints"), F.col("place")).select(F.col("least.__row").alias("__row")).distinct()
    return rows.join(first, "__row", "left_semi").select(docs.columns)
