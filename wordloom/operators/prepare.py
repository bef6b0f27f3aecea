"""From rows to posts: projection under a schema, metadata, last-write-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.schema import Schema


def joined(parts: list[Column]) -> Column:
    """Non-empty parts joined by a space, trimmed."""
    return trimmed(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def project(rows: DataFrame, schema: Schema, fields: str = "fields") -> DataFrame:
    """Adds title, url, meta, body from a map of field to text. The title is the first indexed field, or
    the url where that field is absent; a body without text is null."""
    at = {f: F.col(fields)[f] for f in schema.all_fields}
    first = schema.indexed_fields[0]
    url = F.coalesce(at[schema.url_field], F.lit(""))
    body = joined([at[f] for f in schema.indexed_fields])
    meta = joined([at[f] for f in schema.metadata_fields]) if schema.metadata_fields else F.lit("")
    title = F.when(F.map_contains_key(fields, first), F.coalesce(at[first], F.lit(""))).otherwise(url)
    return rows.select(*[c for c in rows.columns if c != fields], title.alias("title"), url.alias("url"), meta.alias("meta"), F.when(body != "", body).alias("body"))


def map_meta(meta: Column) -> Column:
    """A map as JSON text with sorted keys; '' for an empty or null one."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta))))
    return F.when(F.size(F.coalesce(meta, F.create_map().cast("map<string,string>"))) == 0, "").otherwise(ordered)


def last_wins(posts: DataFrame, order: str) -> DataFrame:
    """One row for each (title, url, meta): the last by order."""
    w = Window.partitionBy("title", "url", "meta").orderBy(F.desc(order))
    return posts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_ids(posts: DataFrame) -> DataFrame:
    """doc_id for posts that have none: their place by (url, title, meta). The rank is made of parts'
    sizes and places within them, so that no single task sees all rows."""
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't coalesced
    parts = posts.repartitionByRange(n, "url", "title", "meta").sortWithinPartitions("url", "title", "meta").withColumn("__at", F.monotonically_increasing_id())
    parts = parts.withColumn("__part", F.shiftright("__at", 33))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    in_part = F.col("__at") - F.shiftleft("__part", 33)
    return parts.join(before, "__part").withColumn("doc_id", (in_part + F.col("__before")).cast("bigint")).drop("__at", "__part", "__before")
