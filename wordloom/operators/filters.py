"""The filter index: an 8-bit xor filter of each document's terms (Graf and Lemire, 2019)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_tokens
from .search import ranked, title_tier

#: Hashes of which filters are built at once.
SLICE = 1 << 18
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, third: int) -> np.ndarray:
    low = np.stack([h & np.uint64(0x1FFFFF), h >> np.uint64(21) & np.uint64(0x1FFFFF), h >> np.uint64(42) & np.uint64(0x1FFFFF)])
    return (low * np.uint64(third) >> np.uint64(21)).astype(np.int64) + np.arange(3)[:, None] * third


def build(hashes: np.ndarray) -> bytes:
    """One byte of seed, four of a third's length, then the fingerprints; keys are peeled in rounds."""
    keys = np.unique(hashes.astype(np.int64).view(np.uint64))
    third = (32 + int(1.23 * len(keys)) + 1) // 3 + 1
    for seed in range(1, 256):
        h = _mixed(keys, seed)
        slots, left, rounds = _slots(h, third), np.arange(len(keys)), []
        while len(left):
            count = np.bincount(slots[:, left].ravel(), minlength=3 * third)
            single = count[slots[:, left]] == 1
            go = single.any(axis=0)
            if not go.any():
                break
            rounds.append((left[go], slots[single.argmax(axis=0)[go], left[go]]))
            left = left[~go]
        if not len(left):
            break
    else:
        raise ValueError("no seed peels all keys")
    table, prints = np.zeros(3 * third, np.uint8), (h >> np.uint64(56)).astype(np.uint8)
    for which, slot in reversed(rounds):
        table[slot] = 0
        table[slot] = prints[which] ^ table[slots[0, which]] ^ table[slots[1, which]] ^ table[slots[2, which]]
    return bytes([seed]) + third.to_bytes(4, "little") + table.tobytes()


def contains(data: bytes, hashes: np.ndarray) -> np.ndarray:
    third, table = int.from_bytes(data[1:5], "little"), np.frombuffer(data, np.uint8, offset=5)
    h = _mixed(hashes.astype(np.int64).view(np.uint64), data[0])
    s = _slots(h, third)
    return (h >> np.uint64(56)).astype(np.uint8) == table[s[0]] ^ table[s[1]] ^ table[s[2]]


def _build_slice(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """build() of several lists of hashes at once: with the first seed, all lists are peeled in the same
    rounds; a list that it doesn't peel, or that has a hash twice, is built alone."""
    third = (32 + (1.23 * counts).astype(np.int64) + 1) // 3 + 1
    base = np.cumsum(3 * third) - 3 * third
    of = np.repeat(np.arange(len(counts)), counts)
    h = _mixed(keys.view(np.uint64), 1)
    low = np.stack([h >> np.uint64(k) & np.uint64(0x1FFFFF) for k in (0, 21, 42)])
    slots = (low * third.astype(np.uint64)[of] >> np.uint64(21)).astype(np.int64) + np.arange(3)[:, None] * third[of] + base[of]
    left, rounds, total = np.arange(len(keys)), [], int(3 * third.sum())
    count = np.bincount(slots.ravel(), minlength=total)
    while len(left):
        at = slots[:, left]
        single = count[at] == 1
        go = single.any(axis=0)
        if not go.any():
            break
        rounds.append((left[go], at[single.argmax(axis=0)[go], np.flatnonzero(go)]))
        np.subtract.at(count, at[:, go].ravel(), 1)
        left = left[~go]
    table, prints = np.zeros(total, np.uint8), (h >> np.uint64(56)).astype(np.uint8)
    for which, slot in reversed(rounds):
        table[slot] = prints[which] ^ table[slots[0, which]] ^ table[slots[1, which]] ^ table[slots[2, which]]
    alone, ends = set(of[left].tolist()), np.cumsum(counts)
    return [build(keys[e - n : e]) if i in alone else b"\x01" + int(t).to_bytes(4, "little") + table[b : b + 3 * t].tobytes() for i, (t, b, n, e) in enumerate(zip(third, base, counts, ends))]


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists of about SLICE hashes in all; one list at least."""
    part = np.cumsum(counts) // SLICE
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(counts)]
    yield from zip(starts, np.append(starts[1:], len(counts)))


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of lists, end to end, how many each list has, and where it begins; a null is an empty one."""
    counts = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().astype(np.int64), counts, np.cumsum(counts) - counts


def _build_all(hashes: pa.Array) -> pa.Array:
    keys, counts, starts = _numbers(hashes)
    out = [f for a, b in _slices(counts) for f in _build_slice(keys[starts[a] : starts[b - 1] + counts[b - 1]], counts[a:b])]
    return pa.array(out, pa.binary())


def _contains_all(data: pa.Array, hashes: pa.Array) -> pa.Array:
    keys, counts, _ = _numbers(hashes)
    bits = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data), b"")[0].as_buffer(), np.uint8) if len(data) else np.zeros(0, np.uint8)
    sizes = pc.binary_length(data).to_numpy().astype(np.int64)
    base = np.cumsum(sizes) - sizes
    third, of = (sizes - 5) // 3, np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + bits[base].astype(np.uint64)[of] * np.uint64(0x9E3779B97F4A7C15)
    h = _mixed(h, 0)
    low = np.stack([h >> np.uint64(k) & np.uint64(0x1FFFFF) for k in (0, 21, 42)])
    s = (low * third.astype(np.uint64)[of] >> np.uint64(21)).astype(np.int64) + np.arange(3)[:, None] * third[of] + base[of] + 5
    found = (h >> np.uint64(56)).astype(np.uint8) == bits[s[0]] ^ bits[s[1]] ^ bits[s[2]]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(found.astype(np.int32)))


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def filter_of(terms: Column) -> Column:
    return F.arrow_udf(_build_all, "binary")(_hashes(terms))


def build_filters(docs: DataFrame) -> DataFrame:
    """docs' columns but terms, with filter; row-local."""
    return docs.select("doc_id", "title", "url", "meta", "title_terms", filter_of(F.col("terms")).alias("filter"))


def member(filter_: Column, terms: Column) -> Column:
    """0 or 1 for each of an array of terms; never 0 for one that the filter holds."""
    return F.arrow_udf(_contains_all, "array<int>")(filter_, _hashes(terms))


def search_filter(filters: DataFrame, query: str, n: int) -> DataFrame:
    """(rank, doc_id, score); whole words only, but for titles."""
    q = query_tokens(filters.sparkSession, query)
    if not q:
        return ranked(filters.select("doc_id", F.lit(0).cast("bigint").alias("score")).filter("false"), n)
    title = sum((title_tier(F.col("title_terms"), t) for t in q), F.lit(0))
    words = member(F.col("filter"), F.array(*map(F.lit, q)))
    score = title + F.aggregate(words, F.lit(0), lambda a, x: a + x)
    return ranked(filters.select("doc_id", score.cast("bigint").alias("score")), n)
