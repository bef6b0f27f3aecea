"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the least node that it is connected with.

    Any ordered column type. Rows with a null end or a = b are ignored; repeated edges are one. Each
    round is written to the shared folder, so that a lost executor costs no earlier round again; the
    rounds end when neither star changes an edge, after about log(nodes) of them.
    """
    now = materialise(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # a forest of stars holds each non-root once, and never a root on the left
        many = nxt.groupBy("a").count().filter("count > 1").limit(1).count()
        deep = nxt.join(nxt.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi").limit(1).count()
        discard(now)
        now = nxt
        if not many and not deep:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
