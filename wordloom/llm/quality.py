"""10: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

A text's features are the distinct hashed words and word pairs in it, each of value 1: words are
runs of letters and digits in lower case, runs of capitals that are followed by a mark, and runs
of other marks; a word that repeats the one before it also gives one shared "repeat" feature. Two
heads share the features, one for low quality and one for toxic text, and a document is kept when
both stay under their thresholds. Scores are sparse dot products with two dense weight vectors of
2**BITS places: their size is fixed, so they can be broadcast at any scale.

Training takes the MAX_LABELLED labelled rows that come first by a hash of doc_id (a documented
bound; every other step covers all rows) in one task, with FTRL-Proximal updates.

Nulls and edges: a null or empty text has no features and scores the bias alone; a very long one takes
time and memory of its own length. Labels with a null doc_id, quality or toxic are not used; of labels
that contradict each other the least quality and the greatest toxic count; of rows that repeat a labelled
doc_id one is learnt from. Repeated rows score alike. With no labelled rows, or with an empty table, all
weights are 0, the bias says no, and every document is kept; other columns of any name pass by.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, distinct, slices, text_key

BITS = 20
MAX_LABELLED = 30_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.4
#: Bias of a model that has seen no labelled row: it rejects nothing.
UNTRAINED = -35.0
HEADS = ("low_quality", "toxic")
_tokens = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
_MASK = np.uint64((1 << BITS) - 1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_REPEAT, _SHOUT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class _Tokens(dict):
    """Token to its hash in lower case; the lowest bit says whether it was in capitals."""

    LIMIT = 100_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shout = len(token) > 2 and token.isupper()
        value = self[token] = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~1 | shout
        return value


def _features(texts: list[str | None], cache: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of the distinct features of some texts, ascending."""
    flat, counts = array("Q"), []
    for t in texts:
        before = len(flat)
        if t:
            flat.extend(map(cache.__getitem__, _tokens(t)))
        counts.append(len(flat) - before)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, of = np.frombuffer(flat, np.uint64), np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
    with np.errstate(over="ignore"):
        shout, h = (h & np.uint64(1)).astype(bool), h | np.uint64(1)
        pair = (h[:-1] * _PAIR) ^ (h[1:] + (h[1:] << np.uint64(7)))
    pair ^= pair >> np.uint64(29)
    pair[h[:-1] == h[1:]] = _REPEAT
    inside = of[:-1] == of[1:]
    loud = distinct(of[shout])
    every = np.concatenate([h, pair[inside], np.full(len(loud), _SHOUT)])
    rows = np.concatenate([of, of[:-1][inside], loud])
    keys = distinct((rows << np.uint64(BITS)) | (every >> np.uint64(13) & _MASK))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & _MASK).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, tuple[int, int]]], places: int = 1 << BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row a place, a column a head) and biases; the updates go over rows in their order."""
    heads = len(HEADS)
    z, n = np.zeros((places, heads)), np.zeros((places, heads))
    zb, nb = np.zeros(heads), np.zeros(heads)

    def weight(z, n, l1=L1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in rows:
            zi, ni = z[at], n[at]
            w, b = weight(zi, ni), weight(zb, nb, 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum(axis=0) + b, -35, 35)))
            g = p - np.array(label, float)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
            more = nb + g * g
            zb += g - (np.sqrt(more) - np.sqrt(nb)) / ALPHA * b
            nb = more
    out = np.zeros((places, heads), np.float32)
    for lo in range(0, places, 1 << 16):
        out[lo : lo + (1 << 16)] = weight(z[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)])
    return out, weight(zb, nb, 0.0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both heads (2**BITS x 2) and their biases."""
    bound_batches(docs.sparkSession)
    # labels that contradict each other count as the worse one
    usable = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").dropna().groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = usable.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(max_labelled)
    # at most max_labelled rows of four numbers: the side's size is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Tokens()
        for b in slices(batches):
            of, places = _features(b.column("text").to_pylist(), cache)
            ends = np.searchsorted(of, np.arange(b.num_rows + 1))
            places = places.astype(np.int32)
            blobs = pa.array([places[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.record_batch([b.column("rank"), b.column("id"), blobs, b.column("quality").cast(pa.int32()), b.column("toxic").cast(pa.int32())], ["rank", "id", "places", "quality", "toxic"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # places stay packed, of 32 bits: at most max_labelled rows are held
        seen = [(np.frombuffer(p, np.int32), (int(q == 0), int(x == 1))) for b in batches for p, q, x in zip(*(b.column(c).to_pylist() for c in ("places", "quality", "toxic")))]
        if not seen:  # repartition(1) may run without rows
            return
        w, b = ftrl(seen)
        for head in range(len(HEADS)):
            at = np.flatnonzero(w[:, head])
            yield pa.record_batch([pa.array(np.full(len(at) + 1, head), pa.int32()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at, head], b[head]), pa.float64())], ["head", "place", "weight"])

    found = rows.mapInArrow(featurise, "rank bigint, id bigint, places binary, quality int, toxic int")
    # of rows that repeat a doc_id one is used; combined before the shuffle
    found = found.groupBy("rank", "id").agg(F.min("places").alias("places"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    model = found.repartition(1).sortWithinPartitions("rank", "id").mapInArrow(fit, "head int, place int, weight double").toPandas()
    w, bias = np.zeros((1 << BITS, len(HEADS)), np.float32), np.full(len(HEADS), UNTRAINED)
    rows_ = model["place"].to_numpy() >= 0
    w[model["place"][rows_], model["head"][rows_]] = model["weight"][rows_]
    bias[model["head"][~rows_]] = model["weight"][~rows_]
    return w, bias


def logits(texts: list[str | None], model: tuple[np.ndarray, np.ndarray], cache: _Tokens) -> np.ndarray:
    """A row a text, a column a head: sparse dot products and biases."""
    (w, bias), (of, places) = model, _features(texts, cache)
    found = w[places]
    return np.stack([np.bincount(of, found[:, k], len(texts)) for k in range(len(HEADS))], axis=1) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, text_key, p_low_quality, p_toxic), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, _Tokens()
        for b in slices(batches):
            p = 1 / (1 + np.exp(-np.clip(logits(b.column("text").to_pylist(), model, cache), -35, 35)))
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "text_key", "p_low_quality", "p_toxic"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, p_low_quality double, p_toxic double")


def kept(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.filter((F.col("p_low_quality") < threshold) & (F.col("p_toxic") < threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))

    @F.arrow_udf("boolean")
    def keeps(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, cache = shared.value, _Tokens()
        for t in texts:
            parts = slices([pa.record_batch([t], ["text"])])
            p = np.concatenate([np.zeros((0, len(HEADS))), *(1 / (1 + np.exp(-np.clip(logits(b.column("text").to_pylist(), model, cache), -35, 35))) for b in parts)])
            yield pa.array((p < threshold).all(axis=1))

    return docs.filter(keeps(F.col("text")))
