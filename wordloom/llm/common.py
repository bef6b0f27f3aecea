"""What the operators share: word hashes in Arrow batches, winnowing, and the scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits of the lower-cased text.
find_words = re.compile(r"[^\W_]+").findall
INF = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class HashCache(dict):
    """Word to 64-bit hash; emptied when full, so that a worker's memory stays bounded."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def fold(text: str) -> str:
    """Lower case of the same length: the one letter whose lower case is longer becomes i."""
    return text.replace("\u0130", "i").lower()


def words_of(text: str | None) -> list[str]:
    """Words of a text; none for a null or empty one."""
    return find_words(fold(text)) if text else []


def hash_words(texts: Iterable[str | None], cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, end to end, and each text's number of words."""
    flat, counts = array("Q"), []
    get = cache.__getitem__
    for text in texts:
        before = len(flat)
        if text:
            flat.extend(map(get, find_words(fold(text))))
        counts.append(len(flat) - before)
    return np.frombuffer(flat, np.uint64) if len(flat) else np.zeros(0, np.uint64), np.array(counts, np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; by a sort, which is many times as fast as a hash table here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def window_hashes(flat: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """At each word the hash of the k words from there on; INF where the text has fewer left.

    The polynomial is put together from halves, in log2(k) passes.
    """
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64)
    done, total, part, width = None, 0, flat.copy(), 1
    power = {1: _BASE}
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if done is None:
                    done, total = part.copy(), width
                else:
                    shifted = np.zeros(n, np.uint64)
                    shifted[: n - total] = part[total:] if total < n else 0
                    done, total = done * power[width] + shifted, total + width
            if width * 2 > k:
                break
            shifted = np.zeros(n, np.uint64)
            if width < n:
                shifted[: n - width] = part[width:]
            part = part * power[width] + shifted
            power[width * 2] = power[width] * power[width]
            width *= 2
        out = mix(done)
    out[out == INF] = 0
    left = np.repeat(starts(counts) + counts, counts) - np.arange(n)
    out[left < k] = INF
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the least hash of some window of w places, the last of several.

    Windows reach over a text's ends, where only INF lies, so that a text of fewer than w
    hashes gives its least one. Takes hashes of k >= w words: the k - 1 INF between two texts
    then keep a window from touching both.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    edge = np.full(w - 1, INF)
    least = np.concatenate([edge, hashes, edge])
    at, width = np.arange(len(least)), 1
    while width < w:
        step = min(width, w - width)
        later = least[step:] <= least[:-step]
        least = np.where(later, least[step:], least[:-step])
        at, width = np.where(later, at[step:], at[:-step]), width + step
    picked = np.zeros(len(hashes) + 2 * w, bool)
    picked[at[least != INF]] = True
    return np.flatnonzero(picked) - (w - 1)


#: Characters (bytes) of text that an operator's Python code takes up at once; one text may be longer.
SLICE_CHARS = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_CHARS, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts have about most bytes, and one row at least."""
    for b in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def text_key() -> Column:
    """With doc_id, what tells rows apart; null for a null text."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


#: Bytes of an Arrow batch between the JVM and Python, where the session names no other bound.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts can be long: Spark's own bound of 64 MB a batch, in both directions, on both sides and in
    each task, takes more memory than the work itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only where none is set and all runs on this machine,
    as in tests; on a cluster a folder that is not shared would lose data, so that is an error."""
    bound_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_one.isDefined():
            return set_one.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark).rstrip('/')}/wordloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and the loss of an
    executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes materialised frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("wordloom-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of a side that is broadcast, by its rows' own sizes.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """df with a broadcast hint if its rows, of row_bytes each, have at most BROADCAST_BYTES together;
    else as it is, for a shuffle join with the same result. df is a materialised frame."""
    if isinstance(row_bytes, int):
        small = df.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes
    else:
        small = (df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if small else df
