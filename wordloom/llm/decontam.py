"""2: benchmark decontamination by winnowing.

Texts become words (runs of letters and digits of the lower-cased text). Of every WINDOW successive
hashes of K words the least is kept as a fingerprint, so that any span of K + WINDOW - 1 = 13 shared
words leaves at least one fingerprint on both sides. Fingerprints of documents and benchmark items
are joined, each hit is extended to both sides as far as the words themselves agree, and spans of at
least 13 words are reported: exactly the maximal shared spans of that length, whatever the hashes.

The benchmark's fingerprints and the texts of the items that have any go to the workers when they have at
most BROADCAST_LIMIT bytes (counted first); a document is then read once and nothing is shuffled. Beyond it both sides' fingerprints are
joined by shuffle and only documents that have a hit are read again. The results are the same.

Nulls and edges: null and empty texts share nothing. An item of K to 12 words counts when a document
has the whole of it (all K-word hashes are then looked up, not the winnowed ones only); an item of
fewer than K words never counts. Null ids are kept as they are; repeated rows give repeated-free
results, as the result has distinct rows. Texts of one id (ties) are searched each. A very long text takes
time of its length and of its number of shared spans: where text and item both repeat a phrase, each
pair of places is a span of its own. Other columns of any name pass by; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INF, HashCache, discard, hash_words, materialise, sized, slices, starts, text_key, window_hashes, winnow, words_of

K, WINDOW = 7, 7
MIN_WORDS = K + WINDOW - 1
BROADCAST_LIMIT = 32 << 20
_SCHEMA = "doc_id bigint, item_id bigint, doc_start int, item_start int, n_words int"
_HIT = np.dtype([("hash", "u8"), ("item", "i8"), ("at", "i4")])


def _needed(n_words: int) -> int:
    return min(MIN_WORDS, n_words)


def fingerprints(texts: list[str | None], cache: HashCache, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word number of the fingerprints of some texts."""
    flat, counts = hash_words(texts, cache)
    hashes = window_hashes(flat, counts, K)
    at = np.flatnonzero(hashes != INF) if every else winnow(hashes, WINDOW)
    of = np.repeat(np.arange(len(counts)), counts)[at] if len(at) else at
    return hashes[at], of, at - starts(counts)[of] if len(at) else at


def spans(doc: list[str], item: list[str], hits: list[tuple[int, int]], one: bool = False) -> list[tuple[int, int, int]]:
    """Maximal spans (start in doc, start in item, words) around hits that are long enough; or one."""
    done: dict[int, int] = {}
    found = []
    for p, q in sorted(hits):
        if p < done.get(p - q, -1):
            continue
        i, j = p, q
        while i and j and doc[i - 1] == item[j - 1]:
            i, j = i - 1, j - 1
        n = p - i
        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
            n += 1
        done[p - q] = i + n
        if n and n >= _needed(len(item)):
            found.append((i, j, n))
            if one:
                break
    return found


def _item_prints(items: DataFrame) -> DataFrame:
    """(hash, item, item_at): short items by all their hashes, as documents then are too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in batches:
            texts = b.column("text").to_pylist()
            lengths = np.array([len(words_of(t)) for t in texts])
            h, of, at = fingerprints(texts, cache, False)
            keep = lengths[of] >= MIN_WORDS if len(of) else np.zeros(0, bool)
            every = fingerprints([t if n < MIN_WORDS else None for t, n in zip(texts, lengths)], cache, True)
            h, of, at = (np.concatenate([x[keep], y]) for x, y in zip((h, of, at), every))
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column("item").take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array(lengths[of] < MIN_WORDS if len(of) else [], pa.bool_())], ["hash", "item", "item_at", "short"])

    return items.mapInArrow(run, "hash bigint, item bigint, item_at int, short boolean")


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "item_id": pa.int64()}
    columns = zip(*found) if found else [[] for _ in names]
    return pa.record_batch([pa.array(c, kinds.get(n, pa.int32())) for c, n in zip(columns, names)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_limit: int = BROADCAST_LIMIT, keyed: bool = False) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words), distinct: every maximal shared span.

    keyed: with text_key beside doc_id, which tells rows of one doc_id apart, and one span for each
    document and item, which is enough to drop it.
    """
    names = ["doc_id", *["text_key"] * keyed, "item_id", "doc_start", "item_start", "n_words"]
    schema = _SCHEMA.replace("doc_id bigint", "doc_id bigint, text_key bigint") if keyed else _SCHEMA
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    items = materialise(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
    prints = materialise(_item_prints(items), "prints")
    size = (prints.count() * 32 + (items.join(prints.select("item").distinct(), "item", "left_semi").agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0))
    every = prints.filter("short").limit(1).count() > 0
    source = docs.select("doc_id", text_key().alias("text_key"), "text")

    if size <= broadcast_limit:
        table = prints.orderBy("hash", "item", "item_at").toPandas()
        known = np.rec.fromarrays([table["hash"].to_numpy().view(np.uint64), table["item"].to_numpy(), table["item_at"].to_numpy()], dtype=_HIT)
        known = known[np.argsort(known["hash"], kind="stable")]
        used = items.join(prints.select("item").distinct(), "item", "left_semi")
        texts = {i: (d, words_of(t)) for d, t, i in used.select("item_id", "text", "item").collect()}
        discard(items, prints)
        shared = docs.sparkSession.sparkContext.broadcast((known, texts))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (known, texts), cache = shared.value, HashCache()
            for b in slices(batches):
                part, found = b.column("text").to_pylist(), []
                h, of, at = fingerprints(part, cache, every)
                hit = np.flatnonzero(np.isin(h, known["hash"], kind="sort")) if len(known) else np.zeros(0, np.int64)
                lo, hi = np.searchsorted(known["hash"], h[hit], "left"), np.searchsorted(known["hash"], h[hit], "right")
                by_pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x, first, last in zip(hit.tolist(), lo.tolist(), hi.tolist()):
                    for k in range(first, last):
                        by_pair.setdefault((int(of[x]), int(known["item"][k])), []).append((int(at[x]), int(known["at"][k])))
                words = {d: words_of(part[d]) for d in {d for d, _ in by_pair}}
                for (d, i), hits in by_pair.items():
                    item_id, item = texts[i]
                    ids = [b.column(n)[d].as_py() for n in names[: 1 + keyed]]
                    found += [(*ids, item_id, *s) for s in spans(words[d], item, hits, keyed)]
                yield _rows(found, names)

        return source.mapInArrow(scan, schema).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in slices(batches):
            h, of, at = fingerprints(b.column("text").to_pylist(), cache, every)
            of = pa.array(of, pa.int64())
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column("doc_id").take(of), b.column("text_key").take(of), pa.array(at, pa.int32())], ["hash", "id", "key", "at"])

    hits = source.mapInArrow(emit, "hash bigint, id bigint, key bigint, at int").join(prints, "hash")
    # a document's hits travel as one row an item, and join the texts that they name
    pairs = hits.groupBy("id", "key", "item").agg(F.collect_set(F.struct("at", "item_at")).alias("hits"))
    pairs = materialise(pairs, "hits")
    read = source.join(pairs.select("id", "key").distinct(), F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key")), "left_semi").distinct()
    both = read.join(pairs, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key"))).join(items.withColumnRenamed("text", "item_text"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield _rows([(*[r[n] for n in names[: 2 + keyed]], *s) for r in rows for s in spans(words_of(r["text"]), words_of(r["item_text"]), [(h["at"], h["item_at"]) for h in r["hits"]], keyed)], names)

    out = materialise(both.select(*names[: 2 + keyed], "text", "item_text", "hits").mapInArrow(verify, schema).distinct(), "spans")
    discard(items, prints, pairs)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that share a span with an item; all columns stay."""
    found = materialise(contaminated(docs, benchmark, keyed=True).select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct(), "contaminated")
    return docs.join(sized(found), F.col("doc_id").eqNullSafe(F.col("__bad_id")) & text_key().eqNullSafe(F.col("__bad_key")), "left_anti")


ORACLE = """
with w as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from benchmark
), dg as (
  select doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') as g from (select doc_id, ws, unnest(range(0, len(ws) - 12)) as i from w where len(ws) >= 13)
), bg as (
  select item_id, j, array_to_string(ws[j + 1 : j + 13], ' ') as g from (select item_id, ws, unnest(range(0, len(ws) - 12)) as j from b where len(ws) >= 13)
), hit as (
  select distinct doc_id, item_id, i, j from dg join bg using (g)
), run as (
  select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from hit
)
select doc_id, item_id, cast(min(i) as integer) as doc_start, cast(min(j) as integer) as item_start, cast(count(*) + 12 as integer) as n_words
from run group by doc_id, item_id, i - j, island
"""
