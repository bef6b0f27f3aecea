"""From documents to packed training sequences: five stages, each over all that the one before kept.

Nulls and edges, beyond what each operator's module states: rows with a null text or doc_id, empty and very
long texts and columns of any name go through all stages; a null or empty text is kept by the first four
and is a piece of no words in the last. Rows that repeat in doc_id and text count as near copies, of which
one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontam, packing, quality, simhash, substring
from wordloom.llm.common import discard, read_table, scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of which nothing is left go."""
    return substring.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a span with an item of the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a training sequence."""
    return packing.packed(docs)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]
#: SQL can express neither the trained classifier nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(docs)  # what the stage before wrote; the tables themselves are left alone
        docs = spark.read.parquet(path)
    return docs
