"""The exact index: documents, terms and blocked posting lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stopwords as stop
from ..functions.text import index_terms, prefix_key, tokens

#: A posting list is split by ranges of doc_id, so that no row grows with the corpus.
SHIFT = 16
BLOCK = 1 << SHIFT
#: Rows of which a task makes pieces of lists at once.
GATHER_ROWS = 1 << 20
PIECE = "term string, block bigint, ids array<bigint>, df bigint"
PIECES = [c.split()[0] for c in PIECE.split(", ")]


class MalformedIndex(ValueError):
    pass


def document_terms(posts: DataFrame, stopwords: Iterable[str] = stop.ENGLISH) -> DataFrame:
    """docs: doc_id, title, url, meta, title_terms, terms; row-local, no shuffle."""
    terms = index_terms([F.col("title"), F.col("meta"), F.col("body")], stopwords)
    return posts.select("doc_id", "title", "url", "meta", F.array_distinct(tokens(F.col("title"))).alias("title_terms"), terms.alias("terms"))


def posting_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term): terms that aren't among their document's own title tokens."""
    return docs.select("doc_id", F.explode(F.array_except("terms", "title_terms")).alias("term"))


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of posting lists (term, block, ids, df) from some rows (doc_id, term) of a task at a time."""

    def pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows["doc_id"].null_count:  # counted, but no list has them
            lost = rows.filter(pc.is_null(rows["doc_id"])).group_by("term", use_threads=False).aggregate([([], "count_all")])
            none = pa.array([[]] * len(lost), pa.list_(pa.int64()))
            yield from pa.table([lost["term"], pa.nulls(len(lost), pa.int64()), none, lost["count_all"]], PIECES).to_batches()
            rows = rows.filter(pc.is_valid(rows["doc_id"]))
        rows = rows.append_column("block", pc.shift_right(rows["doc_id"], SHIFT))
        found = rows.group_by(["term", "block"], use_threads=False).aggregate([("doc_id", "list"), ([], "count_all")])
        yield from found.select(["term", "block", "doc_id_list", "count_all"]).rename_columns(PIECES).to_batches(4096)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER_ROWS:
            yield from pieces(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from pieces(pa.Table.from_batches(held))


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists from pieces sorted by (term, block); ids are put in order within each list."""

    def differs(c: pa.Array) -> np.ndarray:
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        return ~(same | (c[1:].is_null().to_numpy(zero_copy_only=False) & c[:-1].is_null().to_numpy(zero_copy_only=False)))

    def lists(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids = rows["ids"].combine_chunks()
        ends = np.append(starts[1:], len(rows))
        sizes = np.add.reduceat(ids.value_lengths().to_numpy(), starts)
        place, block = np.repeat(np.arange(len(starts)), sizes), pc.fill_null(rows["block"], 0).to_numpy()[starts]
        low = np.sort(place << SHIFT | ids.flatten().to_numpy() & BLOCK - 1) & BLOCK - 1
        whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), low + (block[place] << SHIFT))
        df = np.add.reduceat(rows["df"].to_numpy(), starts)
        keys = rows.select(["term", "block"]).take(pa.array(ends - 1)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), whole, pa.array(df, pa.int64())], PIECES)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        term, block = rows["term"].combine_chunks(), rows["block"].combine_chunks()
        starts = np.append(0, np.flatnonzero(differs(term) | differs(block)) + 1)
        held = rows.slice(starts[-1])  # the next batch may go on with it
        if len(starts) > 1:
            yield lists(rows.slice(0, starts[-1]), starts[:-1])
    if held is not None:
        yield lists(held.combine_chunks(), np.array([0]))


def build_postings(pairs: DataFrame) -> DataFrame:
    """(p3, term, block, doc_ids, df) of distinct (doc_id, term). Each task gathers pieces of lists, so that
    few rows are shuffled; pieces are merged as they come in the order of their keys."""
    kind = dict(pairs.dtypes)["doc_id"]
    pieces = pairs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "term").mapInArrow(_gathered, PIECE)
    whole = pieces.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merged, PIECE)
    return whole.select(prefix_key(F.col("term")).alias("p3"), "term", "block", F.col("ids").cast(f"array<{kind}>").alias("doc_ids"), "df")


def sorted_layout(postings: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by term: row groups then skip by prefix."""
    return postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(term, df)."""
    return pairs.groupBy("term").agg(F.count("*").alias("df"))


def violations(postings: DataFrame) -> DataFrame:
    """Rows that break an invariant: an empty list, a wrong count, ids that don't strictly increase or
    lie outside their block, an empty term or one with a line break, a wrong prefix."""
    ids = F.col("doc_ids")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), lambda i: (F.size(ids) < 2) | (F.get(ids, i) > F.get(ids, i - 1)))
    inside = F.forall(ids, lambda x: F.floor(x / BLOCK) == F.col("block"))
    good = (F.size(ids) > 0) & (F.size(ids) == F.col("df")) & rising & inside & (F.col("term") != "") & ~F.col("term").contains("\n") & (F.col("p3") == prefix_key(F.col("term")))
    return postings.filter(~F.coalesce(good, F.lit(False)))


def check(postings: DataFrame) -> None:
    if not violations(postings).isEmpty():
        raise MalformedIndex("a posting list breaks the index's invariants")
