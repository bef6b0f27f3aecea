"""Tables as collections of posts: (doc_id, title, url, meta, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """more: columns of the table besides."""
    d = read(spark, sf_dir, "documents")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return d.select("doc_id", title.alias("title"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.concat_ws(" ", "lang", "source").alias("meta"), F.col("text").alias("body"), *more)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of HTML."""
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), "url", F.lit("").alias("meta"), F.col("html").alias("body"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product catalogue."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("url"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("meta"), F.concat_ws(" ", "p_name", "p_type").alias("body"))
