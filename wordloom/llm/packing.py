"""1: best-fit packing of documents into training sequences by linear grouping.

A document's length is its number of words (of white-space separated runs), or a column of lengths
that is given. It is cut into pieces of CAPACITY and a rest. Rests over CAPACITY / LARGE are large:
they are sorted, split into GROUPS groups of equal cardinality and rounded up to the longest of
their group. The few sizes that remain are packed by configurations (the patterns of a sequence):
the linear program over patterns is solved by column generation with a revised simplex and a
knapsack over the capacity, and its solution is rounded up. Actual documents, longest first, take
the places of their group's rounded size. The rest is placed by best fit, longest first: into the
sequence with the least room that suffices, or a new one.

Documents are spread over shards of about SHARD_ROWS by a hash and each shard is packed on its own,
so the work is linear in the input and each task's memory is bounded; a shard loses at most the
rounding of its GROUPS patterns, against thousands of sequences.

Nulls and edges: a null or empty text has 0 words and takes no room: one piece of 0 words with a
null sequence. A very long text is as many pieces as it fills. Repeated rows are packed each on their own. Ties go by doc_id (null first), then by
the text's hash. Other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_key

CAPACITY = 2048
LARGE = 8
GROUPS = 24
SHARD_ROWS = 50_000


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how many of each size) and how often each is used: an optimal basis of
    min sum(x), patterns' x >= demand."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * m):
        inverse = np.linalg.inv(basis)
        x, y = inverse @ demand, np.ones(m) @ inverse
        best, came = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = [(int(s), v, i) for i, (s, v) in enumerate(zip(sizes, y)) if v > 1e-12]
        least = min(s for s, _, _ in order) if order else capacity + 1
        for c in range(least, capacity + 1):
            top, at = best[c - 1], -1
            for s, v, i in order:
                if s <= c and best[c - s] + v > top + 1e-12:
                    top, at = best[c - s] + v, i
            best[c], came[c] = top, at
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if came[c] >= 0:
                column[came[c]] += 1
                c -= int(sizes[came[c]])
            else:
                c -= 1
        d = inverse @ column
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis.T, np.linalg.inv(basis) @ demand


class _Rooms:
    """Sequences by the room that is left; finds the least room that suffices."""

    def __init__(self, capacity: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: a sequence has room r

    def put(self, sequence: int, room: int) -> None:
        self.at[room].append(sequence)
        self.some |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fits = self.some >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        sequence = self.at[room].pop()
        if not self.at[room]:
            self.some &= ~(1 << room)
        return sequence, room


def pack(lengths: np.ndarray, capacity: int = CAPACITY, large: int = LARGE, n_groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """For items of 1 .. capacity words: the sequence of each, and its offset there."""
    n = len(lengths)
    sequence, offset = np.full(n, -1), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    big = order[: int((lengths > capacity / large).sum())]
    rooms, made = _Rooms(capacity), 0

    def place(item: int, to: int, room: int) -> None:
        sequence[item], offset[item] = to, capacity - room
        rooms.put(to, room - int(lengths[item]))

    if len(big):
        parts = np.array_split(big, min(n_groups, len(big)))  # equal cardinality, longest first
        rounded = np.array([lengths[p[0]] for p in parts])
        sizes, first = np.unique(rounded, return_inverse=True)
        queues: list[list[int]] = [[] for _ in sizes]
        for p, s in zip(parts, first):
            queues[s] += p.tolist()
        queues = [q[::-1] for q in queues]  # taken from the end: longest first
        demand = np.array([len(q) for q in queues], float)
        for pattern, times in zip(*_patterns(sizes, demand, capacity)):
            for _ in range(int(np.ceil(times - 1e-6))):
                used = 0
                for s in np.flatnonzero(pattern)[::-1]:
                    for _ in range(int(pattern[s])):
                        if queues[s]:
                            item = queues[s].pop()
                            sequence[item], offset[item] = made, used
                            used += int(lengths[item])
                if used:
                    rooms.put(made, capacity - used)
                    made += 1
        left = [i for q in queues for i in q]
    else:
        left = []
    for item in [*left, *order[len(big) :].tolist()]:
        fit = rooms.take(int(lengths[item]))
        if fit is None:
            place(item, made, capacity)
            made += 1
        else:
            place(item, *fit)
    return sequence, offset


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n = pa.array([len(t.split()) if t else 0 for t in b.column("text").to_pylist()], pa.int32())
        yield pa.record_batch([b.column("doc_id"), b.column("text_key"), n], ["doc_id", "text_key", "n_words"])


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, length: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_words, shard, sequence, offset): a row for each piece of a document;
    start counts words in the document, offset in the sequence (shard, sequence).

    length: a column of docs with lengths to use instead of words.
    """
    if length:
        counted = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.col(length), F.lit(0)).cast("int").alias("n_words"))
    else:
        counted = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_count, "doc_id bigint, text_key bigint, n_words int")
    counted = materialise(counted, "lengths")
    shards = max(1, -(-counted.count() // shard_rows))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "doc_id", "text_key"], ascending=[False, True, True], na_position="first", kind="stable")
        n = frame["n_words"].to_numpy().astype(np.int64)
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[row] - piece * capacity)
        some = np.flatnonzero(size > 0)
        seq, off = np.full(len(row), -1), np.zeros(len(row), np.int64)
        seq[some], off[some] = pack(size[some], capacity)
        out = pd.DataFrame({"doc_id": frame["doc_id"].array[row], "piece": piece, "start": piece * capacity, "n_words": size, "shard": int(frame["shard"].iloc[0]), "sequence": pd.array(seq, "Int64"), "offset": off})
        out.loc[size == 0, "sequence"] = pd.NA
        return out

    spread = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(one, "doc_id bigint, piece int, start int, n_words int, shard int, sequence bigint, offset int")
