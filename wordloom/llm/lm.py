"""5: n-gram language-model scores from a log-frequency Bloom filter.

Every word n-gram of the corpus, up to ORDER words, is counted over all documents. Its count c is
quantised to level 1 + floor(log2 c), and the n-gram is put into the filter once for each level from 1
up to its own, as PROBES bits of one 64-bit word of the filter; to look it up, level after level is probed
until one is absent. A level is therefore never too low, and too high by one with the filter's
false-positive rate (about 0.4 %).

The filter lies in parts by the n-gram's hash. Map tasks count what they hold, send one packed blob a
part, and one task builds each part: no count reaches the driver. When all parts together have at
most BROADCAST_LIMIT bytes (the size is checked), they go to the workers and documents are scored
where they are read. Beyond it the documents' n-grams travel to the parts and their levels back, in
packed blobs again; results are the same to the last bit.

Probabilities interpolate: an order's relative frequency (of quantised counts, 1 at most) weighs
LAMBDA, the next lower order's probability the rest; the words' own are add-one smoothed.

Nulls and edges: a null text has null words and score; a text without words 0 words and a null
log_prob. Repeated rows count, and are scored, each. A long text is a document like others. Other
columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INF, HashCache, discard, distinct, hash_words, materialise, mix, slices, starts, text_key, window_hashes

ORDER = 2
LAMBDA = 0.7
BITS_PER_KEY, PROBES = 16, 6
BROADCAST_LIMIT = 256 << 20
PART_NGRAMS = 1 << 22
BATCH_WORDS = 1 << 19
_FLUSH = 3 << 20
_SEED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_32 = np.uint64(32)
#: The middle of each level's counts; 0 at level 0.
COUNTS = np.append(0.0, 0.75 * np.exp2(np.arange(1.0, 65.0)) - 0.5)


def ngram_hashes(flat: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """At each word, the hash of the n-gram that starts there; INF where a text has fewer words left."""
    h = window_hashes(flat, counts, n)
    valid = h != INF
    out = mix(h ^ _SEED[n])
    out[out == INF] = 0
    out[~valid] = INF
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of an n-gram: ascending with its hash."""
    return ((h >> _32) * np.uint64(parts) >> _32).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), exactly."""
    return np.frexp(counts.astype(np.float64))[1]


def count_of(levels: np.ndarray) -> np.ndarray:
    return COUNTS[levels]


def _probe(h: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that holds an n-gram's bits at a level, and its PROBES bits."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64(level) * _SEED[0])
    at, bits = ((x >> _32) * np.uint64(words) >> _32).astype(np.int64), np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (x >> np.uint64(6 * k) & np.uint64(63))
    return at, bits


def build_part(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of distinct n-grams h, in words of 64 bits; an n-gram's bits at a level lie in one."""
    levels = level_of(counts)
    out = np.zeros(max(1, int(levels.sum()) * BITS_PER_KEY // 64), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, bits = _probe(h[levels >= level], level, len(out))
        by = np.argsort(at)
        first = np.flatnonzero(np.diff(at[by], prepend=-1))
        out[at[by][first]] |= np.bitwise_or.reduceat(bits[by], first)
    return out


def levels_in(part: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Level of each n-gram by repeated membership probes."""
    out, left, level = np.zeros(len(h), np.uint8), np.arange(len(h)), 1
    while len(left) and level < 64:
        at, bits = _probe(h[left], level, len(part))
        left = left[part[at] & bits == bits]
        out[left] = level
        level += 1
    return out


def _packed(h: np.ndarray) -> bytes:
    """Ascending hashes as differences, of six bytes each where all fit."""
    d = np.diff(h, prepend=np.uint64(0))
    if len(d) > 1 and int(d[1:].max()) < 1 << 48:
        return b"\6" + d[:1].tobytes() + d[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\0" + h.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.uint64, offset=1)
    short = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    d = np.zeros((len(short) + 1, 8), np.uint8)
    d[1:, :6] = short
    d = d.view(np.uint64)[:, 0]
    d[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(d, dtype=np.uint64)


def log_probs(counts: np.ndarray, levels: list[np.ndarray], total: int) -> np.ndarray:
    """Log probability of each text, from its words' levels: levels[n - 1] at each word, of the n-gram
    that starts there."""
    words = len(levels[0])
    own = count_of(levels[0])
    p = (own + 1) / (total + total ** 0.5 + 1)  # add-one, with room for as many unseen words as a root
    left = np.arange(words) - np.repeat(starts(counts), counts)  # words before this one in its text
    history = own
    for n in range(2, len(levels) + 1):
        joint = count_of(levels[n - 1])
        # the n-gram that ends here starts n - 1 words before
        ends, before = np.zeros(words), np.zeros(words)
        ends[n - 1 :], before[n - 1 :] = joint[: max(0, words - n + 1)], history[: max(0, words - n + 1)]
        has = (left >= n - 1) & (before > 0)
        ratio = np.where(has, np.minimum(1.0, ends / np.where(before > 0, before, 1)), 0)
        p = np.where(has, LAMBDA * ratio + (1 - LAMBDA) * p, p)
        history = joint
    lp = np.log(p)
    return np.array([lp[a : a + c].sum() for a, c in zip(starts(counts), counts)])


def train(docs: DataFrame, order: int = ORDER, part_ngrams: int = PART_NGRAMS) -> tuple[DataFrame, int, int]:
    """(part, bits, words), the filter in the shared folder, where words add up to those of the corpus;
    that sum; the number of parts."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    parts = max(1, -(-chars * order // 4 // part_ngrams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size, words = HashCache(), [], 0, 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            c, h = np.diff(np.append(at, len(h))).astype(np.uint32), h[at]
            bounds = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
            mine = np.flatnonzero(np.diff(bounds))
            cuts = list(zip(bounds[mine], bounds[mine + 1]))
            return pa.record_batch([pa.array(mine.astype(np.int32)), pa.array([_packed(h[a:b]) for a, b in cuts], pa.binary()), pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([words] + [0] * (len(mine) - 1), pa.int64())], ["part", "h", "c", "words"])

        for b in slices(batches):
            flat, counts = hash_words(b.column("text").to_pylist(), cache)
            words += len(flat)
            for n in range(1, order + 1):
                h = ngram_hashes(flat, counts, n)
                held.append(h[h != INF])
                size += len(held[-1])
            if size >= _FLUSH:
                yield flush()
                held, size, words = [], 0, 0
        if size:
            yield flush()

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            h = np.concatenate([_unpacked(x) for x, _, _ in held])
            c = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in held])
            by = np.argsort(h)
            h, c = h[by], c[by].astype(np.int64)
            first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([build_part(h[first], np.add.reduceat(c, first)).tobytes()], pa.binary()), pa.array([sum(w for _, _, w in held)], pa.int64())], ["part", "bits", "words"])

        for b in frames:
            for p, h, c, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                if p != part:
                    if held:
                        yield done()
                    part, held = p, []
                held.append((h, c, w))
        if held:
            yield done()

    counted = docs.select("text").mapInArrow(count, "part int, h binary, c binary, words bigint")
    filter_ = counted.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(build, "part int, bits binary, words bigint")
    filter_ = materialise(filter_, "filter")
    return filter_, filter_.agg(F.sum("words")).first()[0] or 0, parts


def _levels(parts: int, filters: dict[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Levels of n-grams over all parts; 0 at INF."""
    out, p = np.zeros(len(h), np.uint8), part_of(h, parts)
    p[h == INF] = parts
    by = np.argsort(p)
    bounds = np.searchsorted(p[by], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        if int(k) in filters:
            at = by[bounds[k] : bounds[k + 1]]
            out[at] = levels_in(filters[int(k)], h[at])
    return out


class _Unigrams(HashCache):
    """Word to its number, with its hash and its level as an n-gram of one word; emptied when full."""

    def __init__(self, parts: int, filters: dict[int, np.ndarray]) -> None:
        super().__init__()
        self.parts, self.filters, self.fresh = parts, filters, []
        self.hashes, self.levels = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def __missing__(self, word: str) -> int:
        self.fresh.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        at = self[word] = len(self)
        return at

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of all texts, end to end, each text's number of words, and the words' levels."""
        if len(self) >= self.LIMIT:
            self.clear()
            self.hashes, self.levels = self.hashes[:0], self.levels[:0]
        at, counts = hash_words(texts, self)
        if self.fresh:
            h = np.array(self.fresh, np.uint64)
            own = ngram_hashes(h, np.ones(len(h), np.int64), 1)
            self.hashes, self.levels = np.append(self.hashes, h), np.append(self.levels, _levels(self.parts, self.filters, own))
            self.fresh = []
        at = at.astype(np.int64)
        return self.hashes[at], counts, self.levels[at]


def _rows(texts: list[str | None], counts: np.ndarray, levels: list[np.ndarray], total: int) -> tuple[list, list]:
    """n_words and log_prob of each text."""
    lp = log_probs(counts, levels, total)
    return [None if t is None else int(n) for t, n in zip(texts, counts)], [float(x) if t is not None and n else None for t, n, x in zip(texts, counts, lp)]


def scores(docs: DataFrame, order: int = ORDER, broadcast_limit: int = BROADCAST_LIMIT, part_ngrams: int = PART_NGRAMS) -> DataFrame:
    """(doc_id, n_words, log_prob), a row for each row of docs, under the model of docs themselves.
    log_prob is the natural logarithm of the whole text's probability, rounded to 6 places."""
    filter_, total, parts = train(docs, order, part_ngrams)
    size = filter_.agg(F.sum(F.length("bits").cast("bigint"))).first()[0] or 0
    if size > broadcast_limit:
        out = _by_shuffle(docs, filter_, order, total, parts)
        discard(filter_)
        return out.withColumn("log_prob", F.round("log_prob", 6))
    filters = {r.part: np.frombuffer(r.bits, np.uint64) for r in filter_.toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    discard(filter_)
    del filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Unigrams(parts, shared.value)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            flat, counts, first = cache.look_up(texts)
            levels = [first] + [_levels(parts, cache.filters, ngram_hashes(flat, counts, n)) for n in range(2, order + 1)]
            n_words, lp = _rows(texts, counts, levels, total)
            yield pa.record_batch([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(lp, pa.float64())], ["doc_id", "n_words", "log_prob"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, log_prob double")
    return out.withColumn("log_prob", F.round("log_prob", 6))


def _grams(texts: list[str | None], order: int, parts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Words of each text, n-grams at each word, the distinct ones, and where each part's begin."""
    flat, counts = hash_words(texts, HashCache())
    grams = [ngram_hashes(flat, counts, n) for n in range(1, order + 1)]
    h = distinct(np.concatenate(grams))
    h = h[:-1] if len(h) and h[-1] == INF else h
    return counts, grams, h, np.searchsorted(part_of(h, parts), np.arange(parts + 1))


def _by_shuffle(docs: DataFrame, filter_: DataFrame, order: int, total: int, parts: int) -> DataFrame:
    """Texts in batches of about BATCH_WORDS words; a batch's distinct n-grams go to their parts."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n_batches = max(1, -(-chars // (BATCH_WORDS * 6)))
    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", text_key()), F.lit(n_batches)).alias("batch"))
    keyed = materialise(keyed.repartition("batch").sortWithinPartitions("batch", "doc_id", "text"), "batches")

    def ask(table: pa.Table) -> pa.Table:
        _, _, h, bounds = _grams(table.column("text").to_pylist(), order, parts)
        mine = np.flatnonzero(np.diff(bounds))
        batch = table.column("batch")[0].as_py()
        return pa.table([pa.array([batch] * len(mine), pa.int64()), pa.array(mine.astype(np.int32)), pa.array([_packed(h[bounds[k] : bounds[k + 1]]) for k in mine], pa.binary())], ["batch", "part", "h"])

    asked = keyed.groupBy("batch").applyInArrow(ask, "batch bigint, part int, h binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["batch", "part", "levels"])
        bits = np.frombuffer(right.column("bits")[0].as_py(), np.uint64)
        found = [levels_in(bits, _unpacked(h)).tobytes() for h in left.column("h").to_pylist()]
        return pa.table([left.column("batch"), left.column("part"), pa.array(found, pa.binary())], ["batch", "part", "levels"])

    answered = asked.groupBy("part").cogroup(filter_.groupBy("part")).applyInArrow(answer, "batch bigint, part int, levels binary")
    answered = materialise(answered, "levels")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        counts, grams, h, bounds = _grams(texts, order, parts)
        levels = np.zeros(len(h) + 1, np.uint8)  # an answer has the levels of the part's n-grams, in their order
        for k, found in zip(right.column("part").to_pylist(), right.column("levels").to_pylist()):
            levels[bounds[k] : bounds[k + 1]] = np.frombuffer(found, np.uint8)
        n, lp = _rows(texts, counts, [np.where(g == INF, 0, levels[np.searchsorted(h, g)]) for g in grams], total)
        return pa.table([left.column("doc_id"), pa.array(n, pa.int64()), pa.array(lp, pa.float64())], ["doc_id", "n_words", "log_prob"])

    out = keyed.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(finish, "doc_id bigint, n_words bigint, log_prob double")
    out = materialise(out, "scores")
    discard(keyed, answered)
    return out
