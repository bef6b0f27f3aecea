"""Ranked keyword search over an exact or a filter index.

Each query token, repeats included, gives a document 3 for an equal title token, else 2 for one that it
is a prefix of (from three characters on), plus 1 for a term that it equals or, from three characters
on, begins. Documents of a positive sum are ranked by it, ties by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import MIN_PREFIX, prefix_key, query_tokens, tokens
from .index import BLOCK, SHIFT

HEAP_ROWS = 10_000
#: Queries that are scored together, with 256 KB of scores each; more make more chunks.
CHUNK = 256
#: Up to so many queries, their words are broadcast.
FEW_QUERIES = 2_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, q, q3) of queries (query_id, query)."""
    each = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "q"))
    return each.withColumn("q3", prefix_key(F.col("q")))


def completes(term: Column, q: Column) -> Column:
    return (term == q) | ((F.length(q) >= MIN_PREFIX) & F.startswith(term, q))


def matching(terms: DataFrame, q: DataFrame) -> DataFrame:
    """terms (p3, term, ...) joined with the query terms that they complete: an equi-join on the prefix."""
    return terms.join(q, (F.col("p3") == F.col("q3")) & completes(F.col("term"), F.col("q")))


def hits(docs: DataFrame, postings: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all matches."""
    content = matching(postings, q).select("query_id", "pos", F.explode("doc_ids").alias("doc_id"), F.lit(0).alias("tier"), F.lit(1).alias("content"))
    titles = docs.select("doc_id", F.explode("title_terms").alias("term")).withColumn("p3", prefix_key(F.col("term")))
    tier = F.when(F.col("term") == F.col("q"), 3).otherwise(2)
    title = matching(titles, q).select("query_id", "pos", "doc_id", tier.alias("tier"), F.lit(0).alias("content"))
    by_token = content.union(title).groupBy("query_id", "pos", "doc_id").agg((F.max("tier") + F.max("content")).alias("points"))
    return by_token.groupBy("query_id", "doc_id").agg(F.sum("points").cast("bigint").alias("score"))


def top(found: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the first n of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")


def _slots(queries: DataFrame) -> DataFrame:
    """(chunk, key, q, q3, uses): a key is the token, or the tokens of rows that repeat a query_id, at one
    place of a query; uses tells which queries of the chunk have it, and how many times."""
    n = queries.count()
    each = query_terms(queries)
    keys = each.groupBy("query_id", "pos").agg(F.sort_array(F.collect_set("q")).alias("qs")).withColumn("key", F.array_join("qs", " "))
    times = keys.groupBy("query_id", "key").agg(F.count("*").alias("times"), F.first("qs").alias("qs"))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // CHUNK) or 1))
    uses = times.groupBy(chunk.alias("chunk"), "key").agg(F.collect_list(F.struct("query_id", "times")).alias("uses"), F.first("qs").alias("qs"))
    slots = uses.select("chunk", "key", "uses", F.explode("qs").alias("q")).withColumn("q3", prefix_key(F.col("q")))
    return F.broadcast(slots) if n <= FEW_QUERIES else slots


class _Scores:
    """Scores of one block of ids for the queries of one chunk, a key at a time."""

    def __init__(self, block: int, n: int | None) -> None:
        self.block, self.n, self.sums = block, n, {}
        self.content, self.title, self.uses = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8), ()

    def close_key(self) -> None:
        points = self.content + self.title
        at = np.flatnonzero(points)
        few = len(at) < BLOCK // 8
        for use in self.uses if len(at) else ():
            if (found := self.sums.get(use["query_id"])) is None:
                found = self.sums[use["query_id"]] = np.zeros(BLOCK, np.int32)
            if few:
                found[at] += points[at].astype(np.int32) * use["times"]
            elif use["times"] == 1:
                found += points
            else:
                found += points.astype(np.int32) * use["times"]
        self.content[:], self.title[:], self.uses = 0, 0, ()

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score): all, or each query's best n."""
        for query_id, sums in self.sums.items():
            at = np.flatnonzero(sums)
            if self.n is not None and len(at) > self.n:
                order = sums[at].astype(np.int64) << SHIFT | BLOCK - 1 - at  # ties by doc_id
                at = np.sort(at[np.argpartition(order, len(at) - self.n)[len(at) - self.n :]])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(query_id, kind), len(at)), pa.array(at + (self.block << SHIFT)), pa.array(sums[at].astype(np.int64))], ["query_id", "doc_id", "score"])


def _scored(n: int | None):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = (), None
        kind = None
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            kind, ids, offsets = c["uses"].type.value_type.field("query_id").type, c["ids"].flatten().to_numpy(), np.append(0, np.cumsum(c["ids"].value_lengths().to_numpy()))
            where = [c[x].to_numpy() for x in ("block", "chunk", "tier")]
            new = np.append(True, pc.not_equal(c["key"][1:], c["key"][:-1]).to_numpy(zero_copy_only=False))[: batch.num_rows]
            for x in where:
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            for i, j in zip(starts, np.append(starts[1:], batch.num_rows)):
                at, key = (where[0][i], where[1][i]), c["key"][i].as_py()
                if (*at, key) != now:
                    if block:
                        block.close_key()
                    if at != now[:2]:
                        if block:
                            yield from block.rows(kind)
                        block = _Scores(int(at[0]), n)
                    now, block.uses = (*at, key), c["uses"][i].as_py()
                low, tier = ids[offsets[i] : offsets[j]] & BLOCK - 1, where[2][i]
                if tier:
                    block.title[low] = tier  # tiers come in order
                else:
                    block.content[low] = 1
        if block:
            block.close_key()
            yield from block.rows(kind)

    return score


def hits_many(docs: DataFrame, postings: DataFrame, queries: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all matches of queries (query_id, query), or of n of each query's best a
    block. What hits() gives, but a key's matches are added up as arrays over a block of ids, so that no
    row is made of a match of one word. Documents without an id are left out."""
    slots, id_kind = _slots(queries), dict(docs.dtypes)["doc_id"]
    content = matching(postings, slots).select("block", "chunk", "key", F.lit(0).alias("tier"), F.col("doc_ids").cast("array<bigint>").alias("ids"), "uses")
    titles = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode("title_terms").alias("term")).withColumn("p3", prefix_key(F.col("term")))
    tier = F.when(F.col("term") == F.col("q"), 3).otherwise(2)
    title = matching(titles, slots).select(F.shiftright("doc_id", SHIFT).alias("block"), "chunk", "key", tier.alias("tier"), F.array("doc_id").alias("ids"), "uses")
    rows = content.union(title).filter("block is not null").repartition("block", "chunk").sortWithinPartitions("block", "chunk", "key", "tier")
    found = rows.mapInArrow(_scored(n), f"query_id {dict(queries.dtypes)['query_id']}, doc_id bigint, score bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_kind))


def search_many(docs: DataFrame, postings: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    return top(hits_many(docs, postings, queries, max(0, n)), n)


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """(rank, doc_id, score): the first n of rows (doc_id, score) with a score. Up to HEAP_ROWS they are
    kept in each task's heap; a larger n is ranked by a sort, as a heap of n rows is reserved at once."""
    best = scored.filter("score > 0").select("doc_id", "score")
    if n <= HEAP_ROWS:
        best = best.orderBy(F.desc("score"), "doc_id").limit(max(0, n))
    ranks = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint")
    return best.withColumn("rank", ranks).filter(F.col("rank") <= n).select("rank", "doc_id", "score")


def literal(spark: SparkSession, query: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(query).alias("query"))


def read_by(pairs: DataFrame, query: str | None) -> DataFrame:
    """Rows with a term under a prefix of the query's tokens, to be taken before lists are made; all for none."""
    if query is None:
        return pairs
    return pairs.filter(prefix_key(F.col("term")).isin(sorted({t[:MIN_PREFIX] for t in query_tokens(pairs.sparkSession, query)})))


def search(docs: DataFrame, postings: DataFrame, query: str, n: int) -> DataFrame:
    """(rank, doc_id, score) of one query; only lists under its tokens' prefixes are read."""
    keys = sorted({t[:MIN_PREFIX] for t in query_tokens(docs.sparkSession, query)})
    # one literal query: a few rows, whatever the data
    q = F.broadcast(query_terms(literal(docs.sparkSession, query)))
    return ranked(hits(docs, postings.filter(F.col("p3").isin(keys)), q), n)


def title_tier(title_terms: Column, q: str) -> Column:
    """3, 2 or 0, within a row."""
    tier = F.when(F.array_contains(title_terms, q), 3)
    if len(q) >= MIN_PREFIX:
        tier = tier.when(F.exists(title_terms, lambda t: F.startswith(t, F.lit(q))), 2)
    return tier.otherwise(0)
