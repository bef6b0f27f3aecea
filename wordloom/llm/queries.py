"""Registered queries opN_<name>: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprint, sharding
from .common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_spans

    return repeated_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words", "first_id", "first_start")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf_dir, "documents"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import bundled

    return bundled(read_table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_groups(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with both scores."""
    from .quality import kept, score, train

    docs = read_table(spark, sf_dir, "documents")
    return kept(score(docs, train(docs, read_table(spark, sf_dir, "labels")))).drop("text_key")


_ALL = (op1_best_fit_packing, op2_decontamination, op3_token_counts, op4_substring_dedup, op5_lm_scores, op6_sharding, op7_warc_bundles, op8_fingerprints, op9_simhash_near_dedup, op10_quality_classifier)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_decontamination": decontam.ORACLE, "op6_sharding": sharding.ORACLE, "op8_fingerprints": fingerprint.ORACLE}
