"""7: WARC records in seekable Zstandard bundles.

Each task writes its rows as WARC/1.1 resource records into bundle files of the shared folder.
Records are gathered into frames of about FRAME_BYTES, each an independent Zstandard frame; a bundle
ends in a skippable frame with the seek table of the Zstandard seekable format (compressed and plain
size of every frame, then number of frames, descriptor, magic). The index that comes back maps each
record to its bundle, frame and the record's offset within the plain frame, so that one record costs
one read of the footer and one of a single frame.

A file's name is its task attempt's own, and the index is written with Spark's commit: it only names
files of attempts that succeeded, and files of others are deleted afterwards. A lost executor loses
nothing, as files and index are in the shared folder.

Nulls and edges: a null payload has no record: its index row has a null bundle. A null url leaves out
the target header. Empty and very long payloads are records like others (a record is never split over
frames, so a frame may be larger). Repeated rows are records of their own, with one record id, which
is a hash of the row. Other columns pass by; an empty table gives no bundle and an empty index.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, scratch, slices

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_size int, offset int, length int"


def record(page_id: int | None, url: str | None, payload: bytes) -> tuple[str, bytes]:
    """A record's id and its bytes."""
    name = uuid.UUID(bytes=xxhash.xxh3_128_digest(repr((page_id, url)).encode("utf-8", "surrogatepass") + payload)).urn
    target = "" if url is None else f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._|')}\r\n"
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\n{target}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return name, head.encode() + payload + b"\r\n\r\n"


def payload_of(data: bytes) -> bytes:
    head, _, rest = data.partition(b"\r\n\r\n")
    return rest[: int(re.search(rb"Content-Length: (\d+)", head)[1])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames of (compressed, plain) bytes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    return struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, _SEEKABLE)


def read_seek_table(file) -> list[tuple[int, int]]:
    """(compressed, plain) bytes of each frame of an open bundle."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table = file.read_at(n * width, size - 9 - n * width)
    return [struct.unpack_from("<II", table, i * width) for i in range(n)]


def read_frame(file, frame: int) -> bytes:
    """The plain bytes of a frame, found by the footer alone."""
    import zstandard

    table = read_seek_table(file)
    return zstandard.ZstdDecompressor().decompress(file.read_at(table[frame][0], sum(c for c, _ in table[:frame])), max_output_size=table[frame][1])


def _files(root: str):
    """pyarrow's file system for a folder, and the path there. Folders named by path, file:, hdfs:, s3: or
    s3a: (which is s3: there), gs: or gcs: are supported; pyarrow raises for others."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))


class _Bundle:
    def __init__(self, fs, path: str) -> None:
        import zstandard

        self.out, self.frames, self.at = fs.open_output_stream(path, compression=None), [], 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.plain, self.size, self.rows = [], 0, []

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.rows.append((page_id, name, self.size, len(data)))
        self.plain.append(data)
        self.size += len(data)

    def flush(self) -> list[tuple]:
        """Ends the frame; its records as (page_id, record_id, frame, frame_start, frame_size, offset, length)."""
        if not self.rows:
            return []
        data = self.compress(b"".join(self.plain))
        self.out.write(data)
        done = [(p, r, len(self.frames), self.at, len(data), o, n) for p, r, o, n in self.rows]
        self.frames.append((len(data), self.size))
        self.at += len(data)
        self.plain, self.size, self.rows = [], 0, []
        return done

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def write_bundles(pages: DataFrame, root: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles under root; returns the index (INDEX), read from
    its table there."""
    spark = pages.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(root)
        fs.create_dir(f"{base}/bundles", recursive=True)
        part, bundle, name = TaskContext.get().partitionId(), None, None

        def rows(found: list[tuple], nothing: list[tuple] = ()) -> pa.RecordBatch:
            every = [(p, r, name, *x) for p, r, *x in found] + [(p, None, None, None, None, None, None, None) for (p,) in nothing]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*every) if every else [[]] * len(kinds)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for b in slices(batches, columns=("html",)):
            nothing = []
            for page_id, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
                if html is None:
                    nothing.append((page_id,))
                    continue
                if bundle is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.zst"
                    bundle = _Bundle(fs, f"{base}/bundles/{name}")
                bundle.add(page_id, *record(page_id, url, html.encode("utf-8", "surrogatepass")))
                if bundle.size >= frame_bytes:
                    yield rows(bundle.flush())
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
            if nothing:
                yield rows([], nothing)
        if bundle is not None:
            yield rows(bundle.flush())
            bundle.close()

    written = pages.select("page_id", "url", "html").mapInArrow(run, INDEX)
    written.write.parquet(f"{root}/index")
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    _sweep(spark, root, index)
    return index


def _sweep(spark: SparkSession, root: str, index: DataFrame) -> None:
    """Deletes bundles of attempts that failed: those that the index doesn't name. One name a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bundles")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        named = {r.bundle for r in index.select("bundle").distinct().toLocalIterator()}
        for status in fs.listStatus(path):
            if status.getPath().getName().lstrip(".").removesuffix(".crc") not in named:
                fs.delete(status.getPath(), False)


def read_records(index: DataFrame, root: str) -> DataFrame:
    """(page_id, record_id, html) of the records of an index, or of any rows of it: each frame that
    holds one is read once a task, by its place in the seek table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _files(root)
        for f in frames:
            out = []
            for bundle, of_bundle in f.groupby("bundle"):
                with fs.open_input_file(f"{base}/bundles/{bundle}") as file:
                    for frame, rows in of_bundle.groupby("frame"):
                        data = read_frame(file, int(frame))
                        out += [(p, r, payload_of(data[o : o + n]).decode("utf-8", "surrogatepass")) for p, r, o, n in zip(rows["page_id"], rows["record_id"], rows["offset"], rows["length"])]
            yield pd.DataFrame(out, columns=["page_id", "record_id", "html"]).astype({"page_id": "Int64"})

    return index.filter("bundle is not null").repartition("bundle", "frame").mapInPandas(run, "page_id bigint, record_id string, html string")


def bundled(pages: DataFrame) -> DataFrame:
    """The index of pages' bundles, written to a new folder of the shared one."""
    return write_bundles(pages, scratch(pages.sparkSession, "warc"))
