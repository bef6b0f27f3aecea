"""JSON arrays of posts, typed or without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPED = "title string, url string, body string, meta map<string,string>"


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """title, url, body, meta; rows without title or url raise when read."""
    rows = spark.read.schema(TYPED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    need = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a post has no {c}"))).otherwise(F.col(c)).alias(c) for c in ("title", "url")]
    return rows.select(*need, "body", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))


def value_text(v: Column | str) -> Column:
    """Text of a JSON value: scalars as they print, of an array its strings joined by spaces, else ''."""
    return F.expr(f"""case when schema_of_variant({v}) like 'ARRAY%' then
      array_join(transform(filter(cast({v} as array<variant>), x -> schema_of_variant(x) = 'STRING'), x -> cast(x as string)), ' ')
      when schema_of_variant({v}) like 'OBJECT%' or schema_of_variant({v}) = 'VOID' or {v} is null then ''
      else cast({v} as string) end""")


def fields_of(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, key, txt): a row for each field of the JSON object in a column."""
    parsed = rows.select(*keys, F.parse_json(F.col(column)).alias("__object"))
    spark = rows.sparkSession
    return parsed.lateralJoin(spark.tvf.variant_explode(F.col("__object").outer())).select(*keys, "key", value_text("value").alias("txt"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(pos, fields): each object of a JSON array file as a map of field to text, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("__all"))
    rows = whole.lateralJoin(spark.tvf.variant_explode(F.col("__all").outer())).select(F.col("pos").cast("bigint").alias("pos"), F.col("value").alias("__post"))
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("__post").outer()).select("key", "value")).select("pos", "key", value_text("value").alias("txt"))
    return each.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("key", "txt"))).alias("fields"))
