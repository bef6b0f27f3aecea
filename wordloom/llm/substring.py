"""4: substring deduplication with a log-structured fingerprint index.

Documents arrive in batches, in the order of doc_id (null first, then by the text's hash). Of every
WINDOW successive hashes of windows of K = 26 words of a text the least is a fingerprint, so that each
window of MIN_WORDS = 50 words leaves one, the same one in every text that has the window. A document
counts once for each of its fingerprints, however often it repeats a passage. The batch's fingerprints
are sorted and merge-joined with the index: immutable runs, sorted and bucketed by hash, each holding
the first document of the hashes that were new in some earlier batch. The batch's new hashes are its own
run, and FANOUT runs of one level are compacted into one of the next. Beside the runs lie the postings
of each batch, all its (hash, document).

Each document is verified with the first document of each of its fingerprints: both texts are read, all
their windows of 50 words compared, and what agrees extended to both sides word by word. That document
may have a part of a passage only. So for each fingerprint about which some window of the document is
still open and which a third document has, the windows of 50 words about it are hashed in all documents
that have it (by the postings), and the document is verified with the first that has an open window. Each
window of 50 words that an earlier document has is thus in some span, whatever the number of batches. Work
is linear in the input: a pair of texts is looked at once, in time of their lengths.

A result row is a span of a document and one place where an earlier document has it; a span inside another
of the same document is left out.

Nulls and edges: null, empty and shorter texts have no spans. Very long texts, of one repeated word too,
take time of their length. Rows that agree in doc_id and text are one document, so repeated rows are not
each other's copies. Documents of equal doc_id (ties) come in the order of their texts' hashes. A repeat
within one document doesn't count. Other columns of any name pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HashCache, discard, find_words, fold, hash_words, materialise, scratch, sized, slices, starts, text_key, window_hashes, winnow, words_of

K = 26
WINDOW = 25
MIN_WORDS = K + WINDOW - 1
BATCHES = 3
FANOUT = 3
_PRINT = "h bigint, doc_id bigint, text_key bigint"
_RUN = _PRINT + ", n bigint, known boolean"
SPANS = "doc_id bigint, text_key bigint, start int, n_words int, first_id bigint, first_key bigint, first_start int"


def _print_places(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints of some texts, end to end, and the window hashes of all places."""
    hashes = window_hashes(flat, counts, K)
    return winnow(hashes, WINDOW), hashes


def _distinct(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where (of, h) stands first."""
    by = np.lexsort((h, of))
    new = np.append(True, (of[by][1:] != of[by][:-1]) | (h[by][1:] != h[by][:-1])) if len(by) else np.zeros(0, bool)
    return by[new]


def _rows(b: pa.RecordBatch, of: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    take = _distinct(of, h)
    rows = pa.array(of[take], pa.int64())
    return pa.record_batch([pa.array(h[take].view(np.int64)), b.column("doc_id").take(rows), b.column("text_key").take(rows)], ["h", "doc_id", "text_key"])


def _prints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in slices(batches):
            flat, counts = hash_words(b.column("text").to_pylist(), cache)
            at, hashes = _print_places(flat, counts)
            yield _rows(b, np.repeat(np.arange(len(counts)), counts)[at], hashes[at])

    return docs.mapInArrow(run, _PRINT)


def _same(a_id: str, a_key: str, b_id: str, b_key: str):
    return F.col(a_id).eqNullSafe(F.col(b_id)) & (F.col(a_key) == F.col(b_key))


class FingerprintIndex:
    """Sorted immutable runs of window hashes, and the postings of each batch, in a folder; a run's
    folder name tells its level."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.runs: list[tuple[int, str, str]] = []
        self.posts: list[str] = []
        fs, root = self._fs()
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    continue
                if name.startswith("run-"):
                    _, level, buckets, _ = name.split("-")
                    table = f"wordloom_{name.replace('-', '_')}"
                    spark.sql(f"create table if not exists {table} ({_RUN}) using parquet clustered by (h) sorted by (h) into {buckets} buckets location '{self.path}/{name}'")
                    self.runs.append((int(level), name, table))
                elif name.startswith("post-"):
                    self.posts.append(name)
        self.runs.sort()

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _delete(self, name: str) -> None:
        fs, root = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, name), True)

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str, str]:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run-{level}-{buckets}-{uuid.uuid4().hex}"
        table = f"wordloom_{name.replace('-', '_')}"
        rows.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(buckets, "h").sortBy("h").saveAsTable(table)
        return level, name, table

    def _drop(self, run: tuple[int, str, str]) -> None:
        self.spark.sql(f"drop table if exists {run[2]}")
        self._delete(run[1])

    def entries(self) -> DataFrame:
        """(h, doc_id, text_key): a row for each hash, with its first document."""
        out = self.spark.createDataFrame([], _PRINT)
        for _, _, table in self.runs:
            out = out.union(self.spark.table(table).filter("not known").select("h", "doc_id", "text_key"))
        return out

    def postings(self) -> DataFrame:
        """(h, doc_id, text_key): all documents of all hashes."""
        return self.spark.read.schema(_PRINT).parquet(*[f"{self.path}/{p}" for p in self.posts])

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text_key, text) whose documents follow all that the index has; returns
        its probes (h, doc_id, text_key, src_id, src_key): the documents that have a hash of an
        earlier document, with the first such document."""
        post = f"post-{uuid.uuid4().hex}"
        _prints(docs).write.parquet(f"{self.path}/{post}")
        prints = self.spark.read.schema(_PRINT).parquet(f"{self.path}/{post}")
        # least document and number are combined before the shuffle: a hash of a million documents is a row a task
        seen = prints.groupBy("h").agg(F.min(F.struct("doc_id", "text_key")).alias("e"), F.count("*").alias("n"), F.lit(False).alias("known"))
        for i, (_, _, table) in enumerate(self.runs):  # hashes of runs are disjoint; no shuffle of a run
            old = self.spark.table(table).filter("not known").select(F.col("h").alias(f"h{i}"), F.struct("doc_id", "text_key").alias(f"e{i}"))
            seen = seen.join(old, F.col("h") == F.col(f"h{i}"), "left").select("h", F.coalesce(f"e{i}", "e").alias("e"), "n", (F.col("known") | F.col(f"h{i}").isNotNull()).alias("known"))
        run = self._write(seen.select("h", "e.doc_id", "e.text_key", "n", "known"), 0)
        self.runs.append(run)
        self.posts.append(post)
        # read as plain files, so that the join is one that may split a frequent hash
        shared = self.spark.read.schema(_RUN).parquet(f"{self.path}/{run[1]}").filter("known or n > 1").select("h", F.col("doc_id").alias("src_id"), F.col("text_key").alias("src_key"))
        return prints.join(shared, "h").filter(~_same("doc_id", "text_key", "src_id", "src_key"))

    def compact(self) -> None:
        """Merges FANOUT runs of one level into one of the next, as long as there are."""
        level = 0
        while level <= max((r[0] for r in self.runs), default=-1):
            same = [r for r in self.runs if r[0] == level]
            if len(same) >= FANOUT:
                merged = None
                for _, _, table in same:
                    one = self.spark.table(table).filter("not known")
                    merged = one if merged is None else merged.union(one)
                buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                run = self._write(merged.repartition(buckets, "h"), level + 1)
                self.runs = [r for r in self.runs if r not in same] + [run]
                for r in same:
                    self._drop(r)
            level += 1

    def drop(self) -> None:
        for r in self.runs:
            self._drop(r)
        for p in self.posts:
            self._delete(p)
        self.runs, self.posts = [], []


class _Text:
    """A text's words, their hashes and those of its windows."""

    def __init__(self, text: str, cache: HashCache) -> None:
        self.text, self.words = text, words_of(text)
        self.flat = np.fromiter(map(cache.__getitem__, self.words), np.uint64, len(self.words))
        self.n = np.array([len(self.words)])
        self.windows = window_hashes(self.flat, self.n, MIN_WORDS)[: max(0, len(self.words) - MIN_WORDS + 1)]
        self._first = None

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window hashes and the first place of each."""
        if self._first is None:
            self._first = np.unique(self.windows, return_index=True)
        return self._first


def _agreeing(a: list[str], i: int, b: list[str], j: int) -> int:
    """Words that agree from a[i] and b[j] on."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = min(n + step, most), step * 2
    step = min(step, most - n)
    while step:
        half = max(1, step // 2)
        if a[i + n : i + n + half] == b[j + n : j + n + half]:
            n += half
            step = min(step - half, most - n)
        elif half == 1:
            break
        else:
            step = half
    return n


def match(doc: _Text, first: _Text) -> list[tuple[int, int, int]]:
    """Spans (start, words, start in first), of MIN_WORDS at least, that hold every window of doc that
    first has; none holds another."""
    if not len(doc.windows) or not len(first.windows):
        return []
    if doc.text == first.text:
        return [(0, len(doc.words), 0)]
    known, where = first.first()
    at = np.minimum(np.searchsorted(known, doc.windows), len(known) - 1)
    places, out, i, k = np.flatnonzero(known[at] == doc.windows), [], 0, 0
    while (k := k + int(np.searchsorted(places[k:], i))) < len(places):
        i = int(places[k])
        j = int(where[at[i]])
        n = _agreeing(doc.words, i, first.words, j)
        if n < MIN_WORDS:  # two windows of one hash
            i += 1
            continue
        a, b = i, j
        while a and b and doc.words[a - 1] == first.words[b - 1]:
            a, b = a - 1, b - 1
        while out and out[-1][0] >= a:
            out.pop()
        out.append((a, i - a + n, b))
        i += n - MIN_WORDS + 1
    return out


def open_prints(doc: _Text, spans: list[tuple[int, int, int]], hashes: list[int]) -> list[int]:
    """Those of hashes, fingerprints of doc, about which doc has a window that is in no span."""
    covered = np.zeros(len(doc.windows) + 1, np.int64)
    for start, n, _ in spans:
        covered[start] += 1
        covered[start + n - MIN_WORDS + 1] -= 1
    bare = np.append(0, np.cumsum(np.cumsum(covered[:-1]) == 0))
    at, h = _print_places(doc.flat, doc.n)
    h = h[at].view(np.int64)
    lo, hi = np.maximum(0, at - (MIN_WORDS - K)), np.minimum(at, len(doc.windows) - 1)
    left = np.isin(h, np.array(hashes, np.int64)) & (hi >= lo) & (bare[np.maximum(hi, lo - 1) + 1] > bare[lo])
    return np.unique(h[left]).tolist()


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(n_id, n_key, text), once, of the documents in keys (n_id, n_key), which are materialised."""
    texts = materialise(docs.join(sized(keys), _same("doc_id", "text_key", "n_id", "n_key")).select("n_id", "n_key", "text"), "texts")
    repeated = texts.groupBy("n_id", "n_key").count().filter("count > 1").limit(1).count()
    return texts.dropDuplicates(["n_id", "n_key"]) if repeated else texts


def _verify(docs: DataFrame, pairs: DataFrame, again: bool) -> DataFrame:
    """SPANS of pairs (doc_id, text_key, src_id, src_key, hs), from the words of both texts, with a null
    h; and, if again, rows of nothing but an h, a hash of hs about which a window is open."""
    keys = pairs.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key")).union(pairs.select("src_id", "src_key")).distinct()
    keys = materialise(keys, "needed")
    texts = _texts(docs, keys)
    own = pairs.join(texts, _same("doc_id", "text_key", "n_id", "n_key")).drop("n_id", "n_key")
    first = texts.select(F.col("n_id").alias("f_id"), F.col("n_key").alias("f_key"), F.col("text").alias("f_text"))
    # joined by the source last: its pairs follow one another
    both = own.join(first, _same("src_id", "src_key", "f_id", "f_key")).select("doc_id", "text_key", "text", "src_id", "src_key", "f_text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, source = HashCache(), None, None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in slices(batches, columns=("text", "f_text")):
            found = []
            for r in b.to_pylist():
                if last != (r["src_id"], r["src_key"]):
                    last, source = (r["src_id"], r["src_key"]), _Text(r["f_text"], cache)
                doc = _Text(r["text"], cache)
                spans = match(doc, source)
                found += [(r["doc_id"], r["text_key"], i, n, r["src_id"], r["src_key"], j, None) for i, n, j in spans]
                if again:
                    found += [(None,) * 7 + (h,) for h in open_prints(doc, spans, r["hs"])]
            columns = list(zip(*found)) if found else [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_key", "start", "n_words", "first_id", "first_key", "first_start", "h"])

    out = materialise(both.mapInArrow(run, SPANS + ", h bigint"), "spans")
    discard(keys, texts)
    return out


def _later_holders(docs: DataFrame, postings: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, text_key, src_id, src_key) by the windows of MIN_WORDS words about hashes (h), in all
    documents that have those: each document with the first that has a window of it."""
    hot = materialise(postings.join(sized(hashes, 8), "h").distinct(), "hot")
    third = hot.groupBy("h").count().filter("count > 2").select("h")
    by_doc = hot.join(third, "h", "left_semi").groupBy(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key")).agg(F.collect_list("h").alias("hs"))
    by_doc = materialise(by_doc, "places")
    texts = docs.join(sized(by_doc, F.size("hs") * 8 + 32), _same("doc_id", "text_key", "n_id", "n_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for b in slices(batches):
            flat, counts = hash_words(b.column("text").to_pylist(), cache)
            at, hashes = _print_places(flat, counts)
            doc, first = np.repeat(np.arange(len(counts)), counts), starts(counts)
            hs = b.column("hs")
            held, known = np.repeat(np.arange(b.num_rows), hs.value_lengths().to_numpy()), hs.flatten().to_numpy()
            # (row, hash) of a place is one of held, known: both sorted by row and hash, runs of equals
            d, h = np.concatenate([held, doc[at]]), np.concatenate([known, hashes[at].view(np.int64)])
            by = np.lexsort((np.arange(len(d)) >= len(held), h, d))
            head = np.append(True, (d[by][1:] != d[by][:-1]) | (h[by][1:] != h[by][:-1])) if len(by) else np.zeros(0, bool)
            mine = by[(by[head] < len(held))[np.cumsum(head) - 1]] if len(by) else by
            at = np.sort(at[mine[mine >= len(held)] - len(held)])
            lo, hi = np.maximum(first[doc[at]], at - (MIN_WORDS - K)), np.minimum(at, (first + counts)[doc[at]] - MIN_WORDS)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, lo[hi >= lo], 1)
            np.add.at(edge, hi[hi >= lo] + 1, -1)
            take = np.flatnonzero(np.cumsum(edge[:-1]))
            yield _rows(b, doc[take], window_hashes(flat, counts, MIN_WORDS)[take])

    windows = materialise(texts.select("doc_id", "text_key", "text", "hs").mapInArrow(run, _PRINT), "windows")
    first = windows.groupBy("h").agg(F.min(F.struct("doc_id", "text_key")).alias("e"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("h", F.col("e.doc_id").alias("src_id"), F.col("e.text_key").alias("src_key"))
    out = windows.join(first, "h").filter(~_same("doc_id", "text_key", "src_id", "src_key")).select("doc_id", "text_key", "src_id", "src_key").distinct()
    out = materialise(out, "later")
    discard(hot, by_doc, windows)
    return out


def repeated_spans(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """SPANS: each span of a document that an earlier document has, with its place there.

    index, history: an index of earlier documents, and their rows (doc_id, text), which are read for the
    texts of spans; docs are then the new documents only, which follow those, and are added to the index.
    Calls on parts of a table, in its order, give together what one call on all of it gives. Without,
    a new index is filled batch by batch and dropped at the end.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_key().alias("text_key"), "text").filter("text is not null")
    every = docs if history is None else docs.union(history.select("doc_id", text_key().alias("text_key"), "text").filter("text is not null"))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    own = index or FingerprintIndex(spark, scratch(spark, "index"))
    order = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(order)
    spark.conf.set(order, "true")  # a bucket of a run is one sorted file: no sort before the merge
    try:
        parts = []
        for i in range(len(bounds) + 1):
            part = docs
            if bounds:
                low = F.lit(True) if i == 0 else F.col("doc_id") > int(bounds[i - 1])
                part = docs.filter((F.col("doc_id").isNull() if i == 0 else F.lit(False)) | (low & (F.col("doc_id") <= int(bounds[i])) if i < len(bounds) else low))
            pairs = own.add(part).groupBy("doc_id", "text_key", "src_id", "src_key").agg(F.collect_set("h").alias("hs"))
            parts.append(materialise(pairs, "pairs"))
            own.compact()
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.union(p)
        found = _verify(every, pairs, True)
        hashes = materialise(found.filter("h is not null").select("h").distinct(), "open")
        later = _later_holders(every, own.postings(), hashes)
        if history is not None:  # documents of earlier calls have theirs
            later = later.join(docs.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key")), _same("doc_id", "text_key", "n_id", "n_key"), "left_semi")
        done = pairs.select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), F.col("src_id").alias("s_id"), F.col("src_key").alias("s_key"))
        new = later.join(done, _same("doc_id", "text_key", "d_id", "d_key") & _same("src_id", "src_key", "s_id", "s_key"), "left_anti")
        new = materialise(new.withColumn("hs", F.array().cast("array<bigint>")), "pairs")
        more = _verify(every, new, False)
        spans = found.filter("h is null").drop("h").union(more.drop("h")).withColumn("end", F.col("start") + F.col("n_words"))
        earlier = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "first_id", "first_key", "first_start").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("reach", F.max("end").over(earlier)).filter("reach is null or reach < end").drop("end", "reach")
        out = materialise(spans, "spans")
        discard(*parts, found, hashes, later, new, more)
        if index is None:
            own.drop()
    finally:
        spark.conf.set(order, before)
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans (start, words), nor what stands between them and the next word."""
    begins = [m.start() for m in re.finditer(r"[^\W_]+", fold(text))] + [len(text)]
    gone = sorted((begins[s], begins[s + n]) for s, n in spans)
    out, at = [], 0
    for a, b in gone:
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return "".join(out) + text[at:]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with each repeated span cut from all but its first document, and n_chars, if there, set
    anew; documents of which no word is left go. All columns stay."""
    found = repeated_spans(docs)
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n_words")).alias("__spans"))
    by_doc = materialise(by_doc.select(F.col("doc_id").alias("__span_id"), F.col("text_key").alias("__span_key"), "__spans"), "cuts")

    def cut_all(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = text.to_pylist()
        for i in np.flatnonzero(spans.is_valid()):
            left = cut(out[i], [(x["start"], x["n_words"]) for x in spans[int(i)].as_py()])
            out[i] = left if find_words(left) else None
        return pa.array(out, pa.string())

    discard(found)
    columns = docs.columns
    joined = docs.join(sized(by_doc, F.size("__spans") * 8 + 32), F.col("doc_id").eqNullSafe(F.col("__span_id")) & text_key().eqNullSafe(F.col("__span_key")), "left")
    # evaluated once a row: the filter on its result isn't pushed below it with a copy of its own
    cut_once = F.arrow_udf(cut_all, "string").asNondeterministic()
    clean = joined.withColumn("text", cut_once("text", "__spans")).filter(F.col("text").isNotNull() | F.col("__spans").isNull())
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns)
