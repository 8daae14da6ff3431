"""Language-model scoring with a log-frequency Bloom filter.

Tokens are the words (A-Z lower-cased, runs without white space) and one end token. Documents with
``crc32(doc_id as text) mod 7`` other than 2 are learned from.

Unigrams and bigrams of all of them are counted. A count c is quantised to the level 1 + floor(log2 c), and the n-gram
enters the filter once for each level up to its own; a probe asks for level 1, 2, ... until one is missing, and the last
one present gives the estimate: of a unigram the middle of the counts of that level, of a bigram their least, and of the
word before it their largest. Estimates give the probabilities:

    p(w | v) = k(v) least(n(v w)) / most(n(v)) + (1 - k(v)) p(w)
    p(w) = (n(w) - D) / N'      of a known word        p(unknown) = D V / N'

The bigram part sums to 1 at most, as no estimate of n(v w) is above its count and none of n(v) below, so p(w | v) does.
Like the base, the model has one class for all unknown words; it gets what absolute discounting takes from the known
ones (D from how many tokens occur once and twice). The weight k(v) of the bigram depends on the level of n(v) and is
fitted by expectation-maximisation over all training tokens, each left out of its own counts.

The filter holds every n-gram, however many there are, in two parts. The n-grams of the highest levels, as many as
``MAX_BITS`` bits hold, are broadcast. The others are in segments, written tables that are never in one place: n-grams
that the broadcast part doesn't hold go to the task that has their segment, and their levels come back. While everything
fits the first part the second is empty. Both parts have ``BITS_PER_EVENT`` bits for each n-gram and level.

Texts are read once. They become chunks of about ``CHUNK`` tokens: a list of the words' hashes and the tokens' places in
it. What is sent around is a chunk's different n-grams by segment, so a frequent one is sent once a chunk. The number of
segments follows the number of different n-grams (estimated from a hash sample of the n-grams of all documents), not that of chunks, so the rows that
carry them don't shrink to single n-grams.

The base score needs exact counts. The most frequent tokens (at most ``FREQUENT``) are broadcast with theirs; occurrences
of all others meet the count table in a join, pre-aggregated per document. Tokens and bigrams are identified by 64-bit and
48-bit hashes.

Intermediate tables are written to the shared folder and deleted once read.

Null text counts as empty: its one token is the end. A null ``doc_id`` is learned from. With nothing to learn from,
N = V = 0 and every probability is 1. Empty table: no rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize

FREQUENT = 1 << 18
#: Bits of the broadcast part of the filter, at most.
MAX_BITS = 1 << 27
BITS_PER_EVENT, PROBES, LEVELS = 12, 4, 48
#: Documents that a task takes in at once, and rows that hold parts of a chunk.
ROWS, BLOBS = 1000, 2
#: Classes of the ratio of the two probabilities that the weights are fitted on, 4 to a doubling around 1; the first: 0.
RATIOS = 256
#: Tokens of a chunk, n-grams that are counted together before they leave a task, and n-grams of a segment, about.
CHUNK, COMBINED, SEGMENT = 1 << 20, 3 << 19, 1 << 22
#: Segments, at least.
LEAST_SEGMENTS = 32
#: Keys in a row of a merged segment.
ROW = 1 << 16
#: N-grams are told apart by 48 bits: fewer than one in ten thousand of 10^9 meet another, far below the filter's error.
_KEY = np.uint64((1 << 48) - 1)
#: One in so many n-grams is in the sample that sizes the segments.
SAMPLED = 1 << 10
#: Words have no white space, so these can't be words.
END, START = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in (b" end", b" start"))
_ONE, _SIX = np.uint64(1), np.uint64(63)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


@contextmanager
def _blobs(spark: SparkSession):
    """Within it, few rows are read and sent to Python at once: they are large."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BLOBS))
    try:
        with arrow_rows(spark, BLOBS):
            yield
    finally:
        spark.conf.set(key, before)


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of several texts as hashes, and where each text ends."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    for words in split:
        words.append(b" end")  # no word has a space
    ends = np.cumsum([len(words) for words in split])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split), repeat(1)), np.uint64, int(ends[-1])), ends


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def unigram_keys(words: np.ndarray) -> np.ndarray:
    return _mix(words) & _KEY


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(v * _M1 + w) & _KEY


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS).astype(np.uint8)


def least(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 of level 0."""
    return np.floor(np.exp2(level.astype(np.float64) - 1))


def most(level: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 of level 0."""
    return np.exp2(level.astype(np.float64)) - 1


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 of level 0."""
    return (least(level) + most(level)) / 2


def _segment(g: np.ndarray, n: int) -> np.ndarray:
    """The segment of a key; it grows with the key."""
    return (g >> np.uint64(24)) * np.uint64(n) >> np.uint64(24)


def _by_segment(g: np.ndarray, n: int):
    """(segment, from, to) of the stretches of sorted keys."""
    seg = _segment(g, n)
    cuts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(g) else np.zeros(0, np.int64)
    return zip(seg[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(g)).tolist())


def _event(g: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of its segment, and the bits there, that stand for an n-gram at a level: one look-up for a probe."""
    h = _mix(g + np.uint64(level * int(_M1) % (1 << 64)))
    bits = _ONE << (h & _SIX)
    for shift in range(6, 6 * PROBES, 6):
        bits |= _ONE << ((h >> np.uint64(shift)) & _SIX)
    return (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32), bits


def enter(words: np.ndarray, g: np.ndarray, level: np.ndarray) -> None:
    """Puts the n-grams of one segment in its words, at each level up to their own."""
    for k in range(1, int(level.max(initial=0)) + 1):
        word, bits = _event(g[level >= k], k, len(words))
        np.bitwise_or.at(words, word, bits)


def probe(words: np.ndarray, segments: int, g: np.ndarray) -> np.ndarray:
    """The level of each n-gram by repeated membership probes. ``words``: of so many segments."""
    size = len(words) // segments
    out = np.zeros(len(g), np.uint8)
    alive, base = np.arange(len(g)), (_segment(g, segments) if segments > 1 else np.zeros(len(g), np.uint64)) * np.uint64(size)
    for level in range(1, LEVELS + 1):
        word, bits = _event(g, level, size)
        there = (words[base + word] & bits) == bits
        alive, g, base = alive[there], g[there], base[there]
        if not len(alive):
            break
        out[alive] = level
    return out


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _pack(key: np.ndarray) -> bytes:
    """Sorted keys of 48 bits as the steps between them, byte by byte: the upper bytes are mostly 0 and take no room."""
    steps = np.diff(key, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(6, -1).T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


_ZSTD = pa.Codec("zstd")


class Chunk:
    """Some documents: where each ends, the hashes of their words, and the tokens as places among those."""

    def __init__(self, held: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.held, self.ends, self.words, self.at = held, ends, words, at
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    COLUMNS = "held array<boolean>, ends binary, words binary, low binary, high binary"

    @staticmethod
    def read(row: dict) -> Chunk:
        ends = np.frombuffer(row["ends"], np.int64)
        low, high = (np.frombuffer(_ZSTD.decompress(row[half], 2 * int(ends[-1])), np.uint16) for half in ("low", "high"))
        return Chunk(np.array(row["held"], bool), ends, np.frombuffer(row["words"], np.uint64), low + (high.astype(np.uint32) << np.uint32(16)))

    def columns(self) -> dict:
        """Places are compressed here: the rows are written and sent more than once."""
        half = lambda x: pa.array([_ZSTD.compress(x.astype(np.uint16).tobytes(), asbytes=True)], pa.binary())
        return {
            "held": pa.array([self.held.tolist()], pa.list_(pa.bool_())), "ends": pa.array([self.ends.astype(np.int64).tobytes()], pa.binary()),
            "words": pa.array([self.words.tobytes()], pa.binary()),
            "low": half(self.at & 0xFFFF), "high": half(self.at >> 16),
        }

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams, those of the words and then of the different bigrams; and the bigram of each token."""
        m = len(self.words)
        before = np.empty(len(self.at), np.int64)
        before[1:] = self.at[:-1]
        before[self.begins] = m
        pair, of = np.unique(before * m + self.at, return_inverse=True)
        v, w = np.divmod(pair, m)
        self.pair_before, self.pair_word = v, w
        return np.concatenate([unigram_keys(self.words), bigram_keys(np.append(self.words, START)[v], self.words[w])]), of


COLUMNS = [c.split()[0] for c in Chunk.COLUMNS.split(", ")]


def _encoded(kind: pa.DataType):
    """Turns documents (doc_id, held_out, text) into chunks."""

    def run(batches):
        chunk, ids, held, x, ends, n = TaskContext.get().partitionId() << 18, [], [], [], [], 0

        def flush():
            found, inverse, times = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            out = Chunk(np.concatenate(held), np.concatenate(ends), found[order], place[inverse])
            keys = out.grams()[0]
            sample = keys[keys & np.uint64(SAMPLED - 1) == 0].view(np.int64)
            values = pa.concat_arrays(ids)
            return pa.record_batch({
                "chunk": pa.array([chunk], pa.int64()), "n": pa.array([n], pa.int64()), "sample": pa.array([sample.tolist()], pa.list_(pa.int64())),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), **out.columns(),
            })

        for batch in batches:
            for low, high, texts in _runs(batch.column(2)):
                of, upto = hashes(texts)
                ids.append(batch.column(0).slice(low, high - low).cast(kind))
                held.append(batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool))
                x.append(of)
                ends.append(upto + n)
                n += len(of)
                if n >= CHUNK:
                    yield flush()
                    chunk, ids, held, x, ends, n = chunk + 1, [], [], [], [], 0
        if n:
            yield flush()

    return run


def encode(docs: DataFrame) -> DataFrame:
    """A table of chunks: chunk, n (tokens), sample, ids (doc_id of each document), and the columns of ``Chunk``."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    arrow = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    with arrow_rows(docs.sparkSession, ROWS):
        return materialize(rows.mapInArrow(_encoded(arrow), f"chunk long, n long, sample array<long>, ids array<{kind}>, {Chunk.COLUMNS}"), "chunks")


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _word_counts(batches):
    """Partial counts (token, n) of training words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        word, n = _summed(np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held]))
        return pa.record_batch({"token": word.view(np.int64), "n": n})

    for row in _rows(batches):
        c = Chunk.read(row)
        n = np.bincount(c.at[np.repeat(~c.held, np.diff(c.ends, prepend=0))], minlength=len(c.words))
        held.append((c.words[n > 0], n[n > 0]))
        if sum(len(w) for w, _ in held) >= COMBINED:
            yield flush()
            held = []
    if held:
        yield flush()


def _gram_counts(segments: int):
    """Partial counts of training n-grams: rows (seg, keys, counts), each with the sorted keys of a segment."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            parts = [*_by_segment(key, segments)]
            return pa.record_batch({
                "seg": pa.array([s for s, *_ in parts], pa.int32()), "keys": pa.array([_pack(key[a:b]) for _, a, b in parts], pa.binary()),
                "counts": pa.array([n[a:b].astype(np.uint32).tobytes() for _, a, b in parts], pa.binary()),
            })

        for row in _rows(batches):
            c = Chunk.read(row)
            keys, of = c.grams()
            learned = np.repeat(~c.held, np.diff(c.ends, prepend=0))
            n = np.concatenate([np.bincount(c.at[learned], minlength=len(c.words)), np.bincount(of[learned], minlength=len(keys) - len(c.words))])
            held.append((keys[n > 0], n[n > 0]))
            if sum(len(k) for k, _ in held) >= COMBINED:
                yield flush()
                held = []
        if held:
            yield flush()

    return run


def _merged(batches):
    """Turns rows (seg, keys, counts), sorted by segment, into (seg, keys, levels, sizes): keys sorted, and how many
    n-grams have each level. What is held are a segment's different n-grams, and as many that may be repeats."""
    seg, held, n = None, [], 0

    def compact():
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    def flush():
        keys, counts = compact()
        level = level_of(counts)
        cuts = range(0, len(keys), ROW)
        return pa.record_batch({
            "seg": pa.array([seg] * len(cuts), pa.int32()), "keys": pa.array([_pack(keys[a : a + ROW]) for a in cuts], pa.binary()),
            "levels": pa.array([level[a : a + ROW].tobytes() for a in cuts], pa.binary()),
            "sizes": pa.array([np.bincount(level[a : a + ROW], minlength=LEVELS + 1).tolist() for a in cuts], pa.list_(pa.int64())),
        })

    room = SEGMENT
    for row in _rows(batches):
        if row["seg"] != seg:
            if held:
                yield flush()
            seg, held, n, room = row["seg"], [], 0, SEGMENT
        held.append((_unpack(row["keys"]), np.frombuffer(row["counts"], np.uint32).astype(np.int64)))
        n += len(held[-1][0])
        if n > room:
            held = [compact()]
            n = len(held[0][0])
            room = 2 * n + SEGMENT
    if held:
        yield flush()


def _filled(cut: int, first: int, rest: int):
    """Turns rows (seg, keys, levels) into the bits of the two parts of the filter: (part, seg, bits). Rows of a segment
    follow each other; where they are in several tasks each gives its bits."""

    def run(batches):
        seg, parts = None, ()

        def flush():
            there = [(k, words) for k, words in parts if words.any()]
            return pa.record_batch({
                "part": pa.array([k for k, _ in there], pa.int32()), "seg": pa.array([seg] * len(there), pa.int32()), "bits": pa.array([w.tobytes() for _, w in there], pa.binary())
            })

        for row in _rows(batches):
            if row["seg"] != seg:
                if parts:
                    yield flush()
                seg, parts = row["seg"], ((1, np.zeros(first, np.uint64)), (2, np.zeros(rest, np.uint64)))
            g, level = _unpack(row["keys"]), np.frombuffer(row["levels"], np.uint8)
            high = level >= cut
            enter(parts[0][1], g[high], level[high])
            enter(parts[1][1], g[~high], level[~high])
        if parts:
            yield flush()

    return run


class Model:
    """counts: DataFrame (token, n), exact; n, vocabulary: N and V of the base; shared: a broadcast of the first part of the
    filter and the frequent tokens with their counts; rest: DataFrame (seg, bits) of the second part, None if that is empty;
    weights: of the bigram, by level of its first word's count, once fitted."""

    def __init__(self, chunks: DataFrame):
        spark = chunks.sparkSession
        with _blobs(spark):
            words = chunks.select(COLUMNS).mapInArrow(_word_counts, "token long, n long")
            self.counts = materialize(words.groupBy("token").agg(F.sum("n").alias("n")), "counts")
        by_level = self.counts.groupBy((F.floor(F.log2("n")).cast("int") + 1).alias("level"), F.floor(F.log2("n") * 8).cast("int").alias("fine")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
        self.vocabulary, self.n = sum(r["v"] for r in by_level), sum(r["n"] for r in by_level)
        once, twice = (sum(r["v"] for r in by_level if r["level"] == 1), sum(r["v"] for r in by_level if r["fine"] == 8))
        start = self.counts.filter(F.col("token") == int(END.view(np.int64))).first()
        self.total = sum(float(estimate(np.array([r["level"]]))[0]) * r["v"] for r in by_level)
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.starts, self.weights = start["n"] if start else 0, None
        different = chunks.select(F.explode("sample").alias("g")).agg(F.approx_count_distinct("g")).first()[0] * SAMPLED
        self.segments = segments = max(LEAST_SEGMENTS, -(-different // SEGMENT))

        with _blobs(spark):
            parts = chunks.select(COLUMNS).mapInArrow(_gram_counts(segments), "seg int, keys binary, counts binary")
            merged = parts.repartition("seg").sortWithinPartitions("seg").mapInArrow(_merged, "seg int, keys binary, levels binary, sizes array<long>")
            grams = materialize(merged, "grams", compression="zstd")
            sizes = {r["level"]: r["v"] for r in grams.select(F.posexplode("sizes").alias("level", "v")).groupBy("level").agg(F.sum("v").alias("v")).collect()}
            events = lambda low, high: sum(k * v for k, v in sizes.items() if low <= k < high)
            self.cut = cut = next(k for k in range(1, LEVELS + 2) if events(k, LEVELS + 1) <= MAX_BITS // BITS_PER_EVENT)
            first, rest = (n * BITS_PER_EVENT // segments // 64 + 1 for n in (events(cut, LEVELS + 1), events(0, cut)))  # words of a segment
            bits = materialize(grams.select("seg", "keys", "levels").mapInArrow(_filled(cut, first, rest), "part int, seg int, bits binary"), "bits")
            discard(grams)
        made = np.zeros((segments, first), np.uint64)
        held = bits.filter("part = 1").select("seg", "bits").toArrow()  # MAX_BITS / 8 bytes, and what segments in several tasks add
        for seg, words in zip(held.column("seg").to_pylist(), held.column("bits")):
            made[seg] |= np.frombuffer(words.as_buffer(), np.uint64)
        del held
        self.rest, self.rest_words = bits.filter("part = 2").select("seg", "bits") if cut > 1 else None, rest
        if cut == 1:
            discard(bits)

        # tokens as frequent as the last class of counts that leaves room for all
        room, fine = FREQUENT, None
        for r in sorted(by_level, key=lambda r: -r["fine"]):
            room -= r["v"]
            if room < 0:
                break
            fine = r["fine"]
        top = self.counts.filter(F.lit(fine is not None) & (F.floor(F.log2("n") * 8) >= (fine or 0))).toArrow()  # FREQUENT rows at most
        token = top.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        self.shared = spark.sparkContext.broadcast((made.reshape(-1), token[order], top.column("n").to_numpy()[order]))

    def numbers(self) -> Numbers:
        return Numbers(self.segments, self.total, self.vocabulary, self.discount, self.starts)


class Numbers:
    """What turns the levels of a chunk's n-grams into probabilities."""

    def __init__(self, segments: int, total: float, vocabulary: int, discount: float, starts: int):
        self.segments, self.total, self.vocabulary, self.discount, self.starts = segments, total, vocabulary, discount, starts

    def unigram(self, level: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(level))
        return np.where(level > 0, estimate(level) - self.discount, self.discount * self.vocabulary) / self.total

    def of_pairs(self, chunk: Chunk, levels: np.ndarray):
        """For each different bigram of a chunk: level of n(v), the most that n(v) is, the least that n(v w) is, p(w)."""
        m = len(chunk.words)
        prior_level = np.append(levels[:m], level_of(np.array([self.starts])))[chunk.pair_before]
        prior = np.where(chunk.pair_before == m, float(self.starts), most(prior_level))
        return prior_level, prior, np.minimum(least(levels[m:]), prior), self.unigram(levels[:m])[chunk.pair_word]

    def log10(self, chunk: Chunk, of: np.ndarray, levels: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Log probability of each token. ``weights``: of the bigram, by level of n(v)."""
        level, prior, both, alone = self.of_pairs(chunk, levels)
        k = weights[level]
        return np.log10(k * both / np.maximum(prior, 1) + (1 - k) * alone)[of]

    def ratios(self, chunk: Chunk, of: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """How many training tokens have a level of n(v) and class of ratio, each left out of its own counts."""
        level, prior, both, alone = self.of_pairs(chunk, levels)
        times = np.bincount(of[np.repeat(~chunk.held, np.diff(chunk.ends, prepend=0))], minlength=len(level))
        own = np.maximum(both - 1, 0) / np.maximum(prior - 1, 1)
        with np.errstate(divide="ignore"):
            ratio = np.log2(own / alone)
        cls = np.where(own > 0, np.clip(np.round(4 * ratio), -RATIOS // 2 + 1, RATIOS // 2 - 1), -RATIOS // 2) + RATIOS // 2
        return np.bincount(level.astype(np.int64) * RATIOS + cls.astype(np.int64), times, minlength=(LEVELS + 1) * RATIOS).astype(np.int64)


def fit_weights(n: np.ndarray) -> np.ndarray:
    """The weights from the counts of ``ratios``, by level."""
    ratio = np.exp2((np.arange(RATIOS) - RATIOS // 2) / 4)
    ratio[0] = 0
    out = np.zeros(LEVELS + 1)
    for level, of in enumerate(n.reshape(LEVELS + 1, RATIOS)):
        k = 0.5 * (of.sum() > 0)
        for _ in range(200):
            k = min(0.999, float(of @ (k * ratio / (k * ratio + 1 - k))) / max(of.sum(), 1))
        out[level] = k
    return out


def _sent(shared, segments: int):
    """Turns chunks into rows (chunk, seg, keys): the n-grams that the broadcast part of the filter doesn't hold."""

    def run(batches):
        filter_ = shared.value[0]
        for row in _rows(batches):
            keys, _ = Chunk.read(row).grams()
            left = np.unique(keys[probe(filter_, segments, keys) == 0])
            parts = [*_by_segment(left, segments)]
            yield pa.record_batch({
                "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()), "seg": pa.array([s for s, *_ in parts], pa.int32()),
                "keys": pa.array([_pack(left[a:b]) for _, a, b in parts], pa.binary()),
            })

    return run


def _pack_levels(level: np.ndarray, below: int) -> bytes:
    """Levels below ``below``, bit by bit, after how many they are."""
    planes = [np.packbits(level >> np.uint8(b) & np.uint8(1)).tobytes() for b in range((below - 1).bit_length())]
    return len(level).to_bytes(8, "little") + b"".join(planes)


def _unpack_levels(packed: bytes, below: int) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    out, size = np.zeros(n, np.uint8), -(-n // 8)
    for b in range((below - 1).bit_length()):
        out |= np.unpackbits(np.frombuffer(packed, np.uint8, size, 8 + b * size), count=n) << np.uint8(b)
    return out


def _answers(size: int, cut: int):
    """Turns rows (seg, part, chunk, keys), sorted by segment and then part (0: the bits of the filter, 1: probes), into
    (chunk, seg, levels)."""

    def run(batches):
        seg, words = None, None
        for row in _rows(batches):
            if row["seg"] != seg:
                seg, words = row["seg"], np.zeros(size, np.uint64)
            if row["part"] == 0:
                words |= np.frombuffer(row["keys"], np.uint64)
            else:
                yield pa.record_batch({
                    "chunk": pa.array([row["chunk"]], pa.int64()), "seg": pa.array([seg], pa.int32()), "levels": pa.array([_pack_levels(np.minimum(probe(words, 1, _unpack(row["keys"])), cut - 1), cut)], pa.binary())
                })

    return run


def _resolved(shared, numbers: Numbers, cut: int):
    """Turns chunks (seg is -1), each followed by the answers to its probes by segment, into the chunks with the levels of
    their n-grams and their ``ratios``."""

    def run(batches):
        held, row, answers = None, None, []

        def flush():
            c = Chunk.read(row)
            keys, of = c.grams()
            levels = probe(shared.value[0], numbers.segments, keys)
            if answers:
                left = np.flatnonzero(levels == 0)
                levels[left] = np.concatenate([_unpack_levels(a, cut) for a in answers])[np.unique(keys[left], return_inverse=True)[1]]
            n = numbers.ratios(c, of, levels)
            there = np.flatnonzero(n)
            return pa.record_batch({
                **{f: held.column(f) for f in held.schema.names if f not in ("seg", "levels")}, "levels": pa.array([levels.tobytes()], pa.binary()),
                "at": pa.array([there.tolist()], pa.list_(pa.int32())), "times": pa.array([n[there].tolist()], pa.list_(pa.int64())),
            })

        for batch in batches:
            for i, seg in enumerate(batch.column("seg").to_pylist()):
                if seg < 0:
                    if row is not None:
                        yield flush()
                    held = batch.slice(i, 1)
                    row, answers = next(_rows([held])), []
                else:
                    answers.append(batch.column("levels")[i].as_py())
        if row is not None:
            yield flush()

    return run


def resolve(chunks: DataFrame, model: Model) -> DataFrame:
    """A table of the chunks with the levels of their n-grams; columns at and times: their ``ratios``."""
    ids = dict(chunks.dtypes)["ids"]
    with _blobs(chunks.sparkSession):
        rows = chunks.select("chunk", F.lit(-1).alias("seg"), "ids", *COLUMNS, F.lit(None).cast("binary").alias("levels"))
        if model.rest is not None:
            sent = chunks.select("chunk", *COLUMNS).mapInArrow(_sent(model.shared, model.segments), "chunk long, seg int, keys binary").withColumn("part", F.lit(1))
            bits = model.rest.select("seg", F.lit(0).alias("part"), F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("keys"))
            met = sent.select(bits.columns).unionByName(bits).repartition("seg").sortWithinPartitions("seg", "part")
            answers = met.mapInArrow(_answers(model.rest_words, model.cut), "chunk long, seg int, levels binary")
            rows = rows.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "seg")
        whole = rows.mapInArrow(_resolved(model.shared, model.numbers(), model.cut), f"chunk long, ids {ids}, {Chunk.COLUMNS}, levels binary, at array<int>, times array<long>")
        return materialize(whole, "resolved", compression="zstd")


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    chunks = encode(docs)
    model = model or Model(chunks)
    resolved = resolve(chunks, model)
    discard(chunks)
    if model.weights is None:
        met = resolved.select(F.explode(F.arrays_zip("at", "times")).alias("t")).groupBy("t.at").agg(F.sum("t.times").alias("n")).collect()
        n = np.zeros((LEVELS + 1) * RATIOS)
        for r in met:  # a row for each level and class of ratio at most
            n[r["at"]] = r["n"]
        model.weights = fit_weights(n)
    shared, weights, numbers = model.shared, model.weights, model.numbers()

    def rate(batches):
        _, token, count = shared.value
        for batch in batches:
            for i, row in enumerate(_rows([batch])):
                c = Chunk.read(row)
                _, of = c.grams()
                model_log = np.add.reduceat(numbers.log10(c, of, np.frombuffer(row["levels"], np.uint8), weights), c.begins)
                found = np.minimum(np.searchsorted(token, c.words), max(len(token) - 1, 0))
                there = token[found] == c.words if len(token) else np.zeros(len(c.words), bool)
                own = np.zeros(len(c.words))
                own[there] = np.log10(count[found[there]] + 1.0)
                known, logs = there[c.at], own[c.at]
                # a document's rare tokens, each with how often it occurs
                rest = np.flatnonzero(~known)
                doc = np.searchsorted(c.ends, rest, "right")
                pair, times = np.unique(doc * len(c.words) + c.at[rest], return_counts=True)
                d, t = np.divmod(pair, max(len(c.words), 1))
                cut = np.searchsorted(d, np.arange(len(c.ends) + 1)).astype(np.int32)
                yield pa.record_batch({
                    "row": (row["chunk"] << 22) + np.arange(len(c.ends)), "doc_id": batch.column("ids").slice(i, 1).flatten(), "held_out": c.held,
                    "n_tokens": np.diff(c.ends, prepend=0), "known": np.add.reduceat(known.astype(np.int64), c.begins), "logs": np.add.reduceat(logs, c.begins), "score": model_log,
                    "rare": pa.ListArray.from_arrays(cut, c.words[t].view(np.int64)), "times": pa.ListArray.from_arrays(cut, times.astype(np.int32)),
                })

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, times array<int>"
    with _blobs(spark):
        rated = materialize(resolved.select("chunk", "ids", *COLUMNS, "levels").mapInArrow(rate, schema), "rated")
    discard(resolved)
    rare = rated.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    met = rare.join(model.counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    log_all = float(np.log10(model.n + model.vocabulary + 1))
    return rated.join(met.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"), "score",
    )


def _runs(column: pa.Array, size: int = 1 << 20):
    """The column in stretches of about so many bytes: (from, to, texts)."""
    length = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    low = 0
    while low < len(column):
        before = length[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(length, before + size, "right")))
        yield low, high, column.slice(low, high - low).to_pylist()
        low = high
