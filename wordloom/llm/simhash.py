"""9: SimHash near-duplicates by an inverted index of shingle hashes and verification.

A document's signature has 128 bits: each bit is the sign of a sum, over the document's distinct
words, of plus or minus one by the word's hash. Two documents are near each other if their signatures
differ in VERIFY = 20 bits at most and the sketches of their three-word shingles (the least SKETCH
hashes) share MIN_COMMON of them: unlike documents in one language can come within VERIFY bits of each
other, the more the larger the corpus, but share no shingles.

The index is complete for such pairs, at any distance up to VERIFY. Bytes of the signatures can't be
its keys: pairs of 14 to 20 bits need not share any, and a tally over the 16 positions needs lists that
grow with the square of the input or 560 keys of three bytes. A near pair shares at least a quarter of
either sketch, though. So the hashes of all sketches are put in one order, by the number of documents
that have them; of a sketch of n hashes the ceil(n / 4) - 1 most frequent are left out, and what only
one document has. The rarest hash that a near pair shares is then a key of both: it has at least
ceil(n / 4) - 1 shared ones after it. Frequent boilerplate is what is left out.

Documents of equal signature and sketch are one entry (node) of the index, so exact copies cost
nothing. Within a list, nodes are compared breadth-first, by both checks: those that pass leave the
list's unvisited part, hence a list of m copies takes about m comparisons, and its edges have the
components of all its near pairs. A list of over BLOCK nodes is split into blocks, and each pair of
blocks is a list of its own: no task holds more than two blocks. Groups are the components of all lists.

Nulls and edges: a null or empty text, or one without letters and digits, has no signature and is
near nothing. A very long text is a document like others: it takes time and memory of its own length.
Rows that agree in doc_id and text are one document. A null doc_id is a document of its own, told apart
by its text. Of a group the least doc_id stays (null comes last), on ties the one with the least hash of
its text. Empty tables give empty results; other columns of any name pass by.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import INF, discard, distinct, find_words, fold, materialise, sized, slices, starts, text_key, window_hashes
from .components import components

VERIFY = 20
#: Least shingle hashes kept of a document; least estimated share of common shingles of a pair.
SKETCH, MIN_COMMON = 64, 0.25
#: Nodes of a list that are compared in one task with as many others.
BLOCK = 1 << 16
_NONE = np.uint32(0xFFFFFFFF)


class Words(dict):
    """Word to its number; lanes has its 128 bits as a byte each, in 16 words of 64 bits, so that up to
    255 rows add up without a carry; hashes has its hash. Emptied between slices when full."""

    LIMIT = 60_000

    def __init__(self) -> None:
        super().__init__()
        self.lanes, self.hashes, self.fresh = np.zeros((self.LIMIT, 16), np.uint64), np.zeros(self.LIMIT, np.uint64), []

    def __missing__(self, word: str) -> int:
        self.fresh.append(xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass")))
        at = self[word] = len(self)
        return at

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, end to end, and each text's number of words."""
        if len(self) >= self.LIMIT:
            self.clear()
        before, flat, counts = len(self), array("i"), []
        for t in texts:
            n = len(flat)
            if t:
                flat.extend(map(self.__getitem__, find_words(fold(t))))
            counts.append(len(flat) - n)
        if self.fresh:
            if len(self) > len(self.hashes):
                self.lanes = np.concatenate([self.lanes[:before], np.zeros((len(self) - before + self.LIMIT, 16), np.uint64)])
                self.hashes = np.concatenate([self.hashes[:before], np.zeros(len(self) - before + self.LIMIT, np.uint64)])
            digests = np.frombuffer(b"".join(self.fresh), np.uint8).reshape(-1, 16)
            self.lanes[before : len(self)] = np.unpackbits(digests, axis=1).view(np.uint64)
            self.hashes[before : len(self)] = digests[:, :8].copy().view(np.uint64)[:, 0]
            self.fresh = []
        return np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.array(counts, np.int64)


def signature(lanes: np.ndarray) -> bytes:
    """128 bits of a text's distinct words, given by their lanes; a sum of zero gives a 0 bit."""
    n, ones = len(lanes), np.zeros(128, np.int64)
    for lo in range(0, n, 255):
        ones += lanes[lo : lo + 255].sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def describe(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature (hi, lo) and sketch of the texts that have words. A sketch is the least SKETCH
    hashes of the distinct shingles, of 32 bits, ascending, filled up with _NONE."""
    flat, counts = words.numbers(texts)
    rows = np.flatnonzero(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    pairs = distinct((of << 32) | flat)
    ends, numbers = np.searchsorted(pairs, (rows + 1) << 32), pairs & 0xFFFFFFFF
    sigs = b"".join(signature(words.lanes[numbers[a:b]]) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))
    h = words.hashes[flat]
    shingles = window_hashes(h, counts, 3)
    first = starts(counts)
    for r in np.flatnonzero((counts > 0) & (counts < 3)):  # all words are the one shingle
        at = int(first[r])
        shingles[at] = window_hashes(h[at : at + counts[r]], counts[r : r + 1], int(counts[r]))[0]
    has = shingles != INF
    keys = distinct((of[has].astype(np.uint64) << np.uint64(32)) | np.minimum(shingles[has] >> np.uint64(32), np.uint64(_NONE - 1)))
    row = (keys >> np.uint64(32)).astype(np.int64)
    n = np.bincount(row, minlength=len(counts))
    rank = np.arange(len(keys)) - starts(n)[row]
    sketch = np.full((len(counts), SKETCH), _NONE, np.uint32)
    least = rank < SKETCH
    sketch[row[least], rank[least]] = keys[least].astype(np.uint32)
    return rows, np.frombuffer(sigs, ">i8").astype(np.int64).reshape(-1, 2), sketch[rows]


def common_shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles in all of two documents' (exact where both have few), for rows
    of sketches."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != _NONE
    first = real.copy()
    first[:, 1:] &= both[:, 1:] != both[:, :-1]
    total = first.sum(axis=1)
    full = (a[:, -1] != _NONE) | (b[:, -1] != _NONE)
    k = np.where(full, np.minimum(SKETCH, total), total)
    twice = np.zeros(both.shape, bool)
    twice[:, :-1] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    return (twice & (np.cumsum(first, axis=1) <= k[:, None])).sum(axis=1) / np.maximum(k, 1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, hi, lo, sketch): the signatures as two longs, for documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            rows, s, sketch = describe(b.column("text").to_pylist(), words)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "text_key", "hi", "lo", "sketch"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, hi bigint, lo bigint, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _order(doc_id: str = "doc_id", key: str = "text_key"):
    """Which document of a group comes first: null ids last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("key"))


def nodes_of(sigs: DataFrame) -> DataFrame:
    """(node, hi, lo, sketch, first, rows): a number for each signature and sketch that differ, with
    the first document and the number of rows."""
    found = sigs.groupBy("hi", "lo", "sketch").agg(F.min(_order()).alias("first"), F.count("*").alias("rows"))
    return materialise(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node, often): the keys of each node, hashes of its sketch that others have too, without
    the most frequent ones that a near pair can do without; often is how many nodes have the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x = _sketches(b.column("sketch"))
                real = x != _NONE
                n = real.sum(axis=1)
                spare = np.repeat(np.ceil(n * MIN_COMMON).astype(np.int32) - 1, n)
                yield pa.record_batch([pa.array(x[real].view(np.int32)), pa.array(np.repeat(b.column("node").to_numpy(), n)), pa.array(spare)], ["key", "node", "spare"])

    every = nodes.select("node", "sketch").mapInArrow(run, "key int, node bigint, spare int")
    # counted before the shuffle; the join may then split a frequent key
    often = every.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("often").desc(), "key"))
    return every.join(often, "key").withColumn("rank", rank).filter("rank > spare").select("key", "node", "often")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x are within VERIFY bits of those of y."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1) <= VERIFY


def _explore(x: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs within one posting list."""
    left, edges = np.arange(len(x)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            hit = np.flatnonzero(_near(x[left], x[p]))
            hit = np.concatenate([hit[lo : lo + 4096][common_shares(sketch[left[hit[lo : lo + 4096]]], sketch[p][None].repeat(len(hit[lo : lo + 4096]), axis=0)) >= MIN_COMMON] for lo in range(0, len(hit), 4096)] or [hit])
            edges += [(p, q) for q in left[hit]]
            queue += list(left[hit])
            left = np.delete(left, hit)
    return edges


def _list_edges(key: np.ndarray, node: np.ndarray, x: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """(a, b), a > b, of nodes: the edges of all lists, which follow one another by key."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(key)))
    found = [np.zeros((0, 2), np.int64)]
    for m in range(2, 9):  # short lists: all pairs, over all lists at once
        first = at[size == m]
        for i, j in combinations(range(m), 2):
            hit = first[_near(x[first + i], x[first + j])]
            hit = hit[common_shares(sketch[hit + i], sketch[hit + j]) >= MIN_COMMON]
            found.append(np.stack([hit + i, hit + j], axis=1))
    for s, m in zip(at[size > 8].tolist(), size[size > 8].tolist()):
        if edges := _explore(x[s : s + m], sketch[s : s + m]):
            found.append(np.array(edges, np.int64) + s)
    pairs = np.sort(node[np.concatenate(found)], axis=1)[:, ::-1]
    return pairs[pairs[:, 0] != pairs[:, 1]]


def near_edges(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of nodes: edges with the same components as all near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        batches, last = iter(batches), False
        seen: set[tuple[int, int]] = set()
        while not last:
            b = next(batches, None)
            last = b is None
            if b is not None:
                now = (b.column("list").to_numpy(), b.column("node").to_numpy(), np.stack([b.column("hi").to_numpy(), b.column("lo").to_numpy()], axis=1), _sketches(b.column("sketch")))
                kept = now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now))
            if kept is None or not len(kept[0]):
                continue
            cut = len(kept[0]) if last else int(np.searchsorted(kept[0], kept[0][-1]))  # the last list may go on
            edges = _list_edges(*(x[:cut] for x in kept))
            kept = tuple(x[cut:] for x in kept)
            new = set(map(tuple, edges.tolist())) - seen
            seen = new if len(seen) > 50_000 else seen | new
            yield pa.record_batch([pa.array([p for p, _ in new], pa.int64()), pa.array([q for _, q in new], pa.int64())], ["a", "b"])

    # a list of n blocks is a list for each two of them; each node is in n of those
    n = F.ceil(F.col("often") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = postings(nodes).withColumn("n", n).withColumn("mine", mine).withColumn("other", other)
    name = F.when(F.col("n") == 1, F.col("key").cast("bigint")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = rows.select(name.alias("list"), "node").join(nodes.select("node", "hi", "lo", "sketch"), "node").select("list", "node", "hi", "lo", "sketch")
    # a list never spans two parts; sorted, its rows follow one another
    return rows.repartition(F.col("list")).sortWithinPartitions("list").mapInArrow(run, "a bigint, b bigint").distinct()


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, keep_id, keep_key): every row of docs that has a near copy, with the document
    of its group that stays; and the signatures. Both are materialised."""
    sigs = materialise(signatures(docs), "signatures")
    nodes = nodes_of(sigs)
    edges = near_edges(nodes)
    roots = components(edges)
    linked = nodes.join(roots, "node", "left").select("hi", "lo", "sketch", "first", "rows", F.coalesce("root", "node").alias("root"))
    linked = materialise(linked, "linked")
    heads = linked.groupBy("root").agg(F.min("first").alias("keep"), F.sum("rows").alias("n")).filter("n > 1").select("root", F.col("keep.id").alias("keep_id"), F.col("keep.key").alias("keep_key"))
    named = materialise(linked.join(heads, "root").drop("first", "rows", "root"), "named")
    out = materialise(sigs.join(named, ["hi", "lo", "sketch"]).select("doc_id", "text_key", "keep_id", "keep_key"), "groups")
    discard(nodes, roots, linked, named)
    return out, sigs


_GOES = "not (doc_id <=> keep_id and text_key = keep_key)"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): each document that goes, and the one of its group that stays in its place."""
    found, sigs = groups(docs)
    discard(sigs)
    return found.filter(_GOES).distinct().select("doc_id", "keep_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group; rows that repeat in doc_id and text are such a
    group too, if the text has words. All columns stay."""
    found, sigs = groups(docs)
    goes = materialise(found.filter(_GOES).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "gone")
    repeated = sigs.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).count().filter("count > 1").drop("count")
    repeated = materialise(repeated, "repeated")
    discard(found, sigs)

    def same(df: DataFrame, how: str, marks: DataFrame) -> DataFrame:
        return df.join(sized(marks), F.col("doc_id").eqNullSafe(F.col("__id")) & text_key().eqNullSafe(F.col("__key")), how)

    left = same(docs, "left_anti", goes)
    if repeated.isEmpty():  # texts are then joined once
        return left
    one = same(left, "left_semi", repeated).withColumn("__key", text_key()).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return same(left, "left_anti", repeated).unionByName(one)
