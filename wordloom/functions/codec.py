"""Posting-list codec: gaps, running sums and variable-length bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class CodecError(ValueError):
    """Malformed bytes."""


def delta(ids: Column) -> Column:
    """First id, then gaps."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(ids, F.greatest(i, F.lit(1)).cast("int"))))


def _summed(gaps: pa.Array) -> pa.Array:
    values, ends = gaps.flatten().to_numpy(), np.cumsum(pc.fill_null(gaps.value_lengths(), 0).to_numpy())
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    sums = np.append(0, np.cumsum(values.astype(np.int64)))
    out = sums[1:] - np.repeat(sums[starts], ends - starts)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, pa.int64()), mask=pc.is_null(gaps) if gaps.null_count else None)


def prefix_sum(gaps: Column) -> Column:
    """Inverse of delta: running sums of each list, over a whole batch of lists at once."""
    return F.arrow_udf(_summed, "array<bigint>")(gaps)


def varint_size(c: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(c < F.lit(1 << 7 * n), F.lit(n)).otherwise(size)
    return size.cast("bigint")


def encode_all(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all numbers, end to end, and how many each has: seven bits a byte, the least first."""
    if (numbers < 0).any():
        raise CodecError("a negative number can't be encoded")
    n = numbers.astype(np.uint64)
    sizes = np.ones(len(n), np.int64)
    for k in range(1, 9):
        sizes += n >> np.uint64(7 * k) > 0
    out, starts = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[starts[has] + k] = (n[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def decode_all(data: np.ndarray, blobs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of encode_all for blobs of so many bytes, end to end: all numbers, and how many each blob has."""
    last = data < 128
    ends = np.cumsum(blobs)
    if (~last[ends[blobs > 0] - 1]).any():
        raise CodecError("the bytes end within a number")
    stop = np.flatnonzero(last)
    start = np.append(0, stop[:-1] + 1) if len(stop) else stop
    sizes = stop - start + 1
    if (sizes > 10).any() or (data[stop[sizes == 10]] > 1).any():
        raise CodecError("a number has more than 64 bits")
    if not len(stop):
        return np.zeros(0, np.int64), np.zeros(len(blobs), np.int64)
    place = (np.arange(len(data)) - np.repeat(start, sizes)).astype(np.uint64)
    values = np.bitwise_or.reduceat((data & 127).astype(np.uint64) << (place * np.uint64(7)), start)
    before = np.append(0, np.cumsum(last))
    return values.view(np.int64), before[ends] - before[ends - blobs]


def encode(numbers: list[int]) -> bytes:
    return encode_all(np.array(numbers, np.int64))[0].tobytes()


def decode(data: bytes) -> list[int]:
    return decode_all(np.frombuffer(data, np.uint8), np.array([len(data)]))[0].tolist()


def _encoded(lists: pa.Array) -> pa.Array:
    data, sizes = encode_all(lists.flatten().to_numpy())
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()))]
    valid = pc.is_valid(lists).buffers()[1] if lists.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _decoded(blobs: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy().astype(np.int64)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(blobs)], pa.int32()), pc.fill_null(blobs, b"")), b"")[0]
    values, counts = decode_all(np.frombuffer(whole.as_buffer() or b"", np.uint8), sizes)
    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values, pa.int64()), mask=pc.is_null(blobs) if blobs.null_count else None)


def varint_encode(ids: Column) -> Column:
    """Bytes of an array of numbers."""
    return F.arrow_udf(_encoded, "binary")(ids)


def varint_decode(data: Column) -> Column:
    return F.arrow_udf(_decoded, "array<bigint>")(data)
