"""8: document fingerprints: exact groups under a canonical form, with bytes compared.

A text's canonical form is NFKC, case-folded, NFKC again, runs of white space as one space, none at
the ends. Its 128-bit xxhash is the fingerprint. Documents are first grouped by fingerprint alone, 16
bytes each; only texts whose fingerprint occurs more than once are read again, and grouped by
fingerprint and canonical text, so that equal buckets are told apart by their bytes. That second
grouping is combined before the shuffle: of a text with a million copies each task sends one.

Nulls and edges: a null text has no fingerprint and is a group of its own; texts of white space only
are all equal. keep_id is a group's least doc_id, null only if all of the group's are. Repeated rows
are copies of each other, and so are rows of one doc_id (ties) if their texts are. A very long text takes
time and memory of its own length. Other columns of any name pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, sized, slices, text_key

DIGEST_BYTES = 16


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canon: str, n_bytes: int = DIGEST_BYTES) -> bytes:
    return xxhash.xxh3_128_digest(canon.encode("utf-8", "surrogatepass"))[:n_bytes]


def fingerprints(docs: DataFrame, n_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, text_key, digest), a row for each row of docs; a null digest for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [None if t is None else digest(canonical(t), n_bytes) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(found, pa.binary())], ["doc_id", "text_key", "digest"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, digest binary")


def exact_groups(docs: DataFrame, n_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, keep_id, copies), a row for each row of docs.

    n_bytes: bytes of the digest that are used; fewer only make equal buckets of unequal texts, which
    the comparison of bytes then parts (tests do so).
    """
    prints = materialise(fingerprints(docs, n_bytes), "digests")
    shared = prints.filter("digest is not null").groupBy("digest").count().filter("count > 1").select("digest")
    many = materialise(prints.join(shared, "digest", "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "many")
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    read = keyed.join(sized(many), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            canon = [canonical(t) for t in b.column("text").to_pylist()]
            digests = pa.array([digest(c, n_bytes) for c in canon], pa.binary())
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), digests, pa.array([c.encode("utf-8", "surrogatepass") for c in canon], pa.binary())], ["doc_id", "text_key", "digest", "canon"])

    texts = read.mapInArrow(run, "doc_id bigint, text_key bigint, digest binary, canon binary")
    classes = texts.groupBy("digest", "canon").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    # the text itself is needed below only where a fingerprint has several; one row's text, of 64 bits, stands for it else
    classes = materialise(classes.select("digest", F.xxhash64("canon").alias("canon_key"), F.when(F.count("*").over(Window.partitionBy("digest")) > 1, F.col("canon")).alias("canon"), "keep_id", "copies"), "classes")
    plain = classes.filter("canon is null").select("digest", "keep_id", "copies")
    rest = prints
    out = None
    if classes.filter("canon is not null").limit(1).count():
        unlike = classes.filter("canon is not null")
        out = texts.join(unlike.select("digest", "canon", "keep_id", "copies"), ["digest", "canon"]).select("doc_id", "keep_id", "copies")
        rest = prints.join(unlike.select("digest").distinct(), "digest", "left_anti")
    joined = rest.join(sized(plain), "digest", "left")
    joined = joined.select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    out = materialise(joined if out is None else joined.union(out), "exact")
    discard(prints, many, classes)
    return out


ORACLE = r"""
with c as (select doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) as canon from documents)
select doc_id, case when canon is null then doc_id else min(doc_id) over (partition by canon) end as keep_id,
  case when canon is null then 1 else count(*) over (partition by canon) end as copies
from c
"""
