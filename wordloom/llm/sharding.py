"""6: sharding by longest-processing-time scheduling.

Rows with one value of a group column stay together. A group's size is the characters of its texts.
Groups, largest first, go to the least-loaded shard (of several, the lowest number), through a heap.

The driver sees sizes, not groups: how many groups have each distinct size (at most about the square
root of twice the corpus). Where many groups have one size the heap would hand them out in rounds, so
whole rounds are taken at once; the outcome is the heap's own. Groups of one size are ranked by a
hash of the group, in 256 parts, and look their shard up by size and rank.

Nulls and edges: the null group is a group like others; a null text has 0 characters, a very long one as
many as it has; groups of size 0 go where the last least-loaded shard is. Repeated rows count each. Ties
go by the hash, then the group. Other columns of any name pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, sized

N_SHARDS = 8


def lpt(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, list[int]]]:
    """Segments (size, first rank, number, shards): of the groups of a size, ranked from 0, the one of
    rank r in the segment goes to shards[(r - first) % len(shards)]. histogram: (size, groups)."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, left in sorted(histogram, reverse=True):
        at = 0
        while left:
            if size == 0:
                out.append((size, at, left, [heap[0][1]]))
                break
            rounds = 0
            if left > 1:
                loads = sorted(heap) if left >= shards else heapq.nsmallest(left + 1, heap)
                least = loads[0][0]
                k = next((i for i, (load, _) in enumerate(loads) if load - least >= size), len(loads))
                rounds = left // k
                if k < len(loads):  # rounds among the k least loaded, until they come up to the next
                    rounds = min(rounds, (loads[k][0] - loads[k - 1][0] - 1) // size + 1)
                elif k < shards:
                    rounds = 0
            if rounds:
                mine = [i for _, i in loads[:k]]
                out.append((size, at, rounds * k, mine))
                grown = {i: load + rounds * size for load, i in loads[:k]}
                heap = [(grown.get(i, load), i) for load, i in heap]
                heapq.heapify(heap)
                at, left = at + rounds * k, left - rounds * k
            else:
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                out.append((size, at, 1, [i]))
                at, left = at + 1, left - 1
    return out


def assign(docs: DataFrame, group: str = "source", shards: int = N_SHARDS) -> DataFrame:
    """(grp, size, shard), a row for each group."""
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(group).alias("grp")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("size"))
    sizes = materialise(sizes.withColumn("h", F.xxhash64("grp")).withColumn("part", F.shiftright("h", 56).cast("int")), "sizes")
    parts = sizes.groupBy("size", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("size").alias("b_size"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy("size", "part").orderBy("h", "grp")) - 1)
    ranked = ranked.join(before, (F.col("size") == F.col("b_size")) & (F.col("part") == F.col("b_part"))).withColumn("rank", F.col("r") + F.col("before"))
    histogram = sizes.groupBy("size").agg(F.count("*").alias("n")).toPandas()
    found = lpt(list(histogram.itertuples(index=False, name=None)), shards)
    segments = spark.createDataFrame(pd.DataFrame(found, columns=["s_size", "first", "n", "shards"]), "s_size bigint, first bigint, n bigint, shards array<int>")
    inside = (F.col("size") == F.col("s_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    shard = F.element_at("shards", ((F.col("rank") - F.col("first")) % F.size("shards") + 1).cast("int"))
    out = materialise(ranked.join(segments, inside).select("grp", "size", shard.alias("shard")), "shards")
    discard(sizes)
    return out


def sharded(docs: DataFrame, group: str = "source", shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, <group>, shard), a row for each row of docs; the last is called assigned if the group is
    a column shard."""
    found = sized(assign(docs, group, shards).select(F.col("grp").alias("__grp"), F.col("shard").alias("__shard")))
    return docs.select("doc_id", group).join(found, F.col(group).eqNullSafe(F.col("__grp"))).select("doc_id", group, F.col("__shard").alias("assigned" if group == "shard" else "shard"))


ORACLE = f"""
with recursive g as (
  select source, row_number() over (order by sum(coalesce(length(text), 0)) desc, source) as i, cast(sum(coalesce(length(text), 0)) as bigint) as size
  from documents group by source
), step as (
  select cast(0 as bigint) as i, [cast(0 as bigint) for _ in range({N_SHARDS})] as loads, cast(null as integer) as shard
  union all
  select g.i, [case when k = s.least then s.loads[k] + g.size else s.loads[k] end for k in range(1, {N_SHARDS + 1})], cast(s.least - 1 as integer)
  from (select i, loads, list_position(loads, list_min(loads)) as least from step) s join g on g.i = s.i + 1
)
select d.doc_id, d.source, step.shard
from documents d join g on d.source is not distinct from g.source join step on step.i = g.i
"""
