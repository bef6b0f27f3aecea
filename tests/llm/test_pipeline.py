"""The pipeline's stages: each decision takes effect, odd rows pass, results agree with each operator's."""

import corpus_pipeline
from pyspark.sql import functions as F

from wordloom.llm import decontam, quality, simhash, substring

SF = "/root/testdata/sf0.001"


def test_stages_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, SF).cache()
        ids = {x.doc_id for x in kept.select("doc_id").collect()}
        was = {x.doc_id for x in before.select("doc_id").collect()}
        assert ids <= was
        if k < 4:
            assert kept.columns == docs.columns
        if k == 0:
            assert ids == {x.doc_id for x in quality.kept(quality.score(before, quality.train(before, labels))).collect()}
        if k == 1:
            assert was - ids == {x.doc_id for x in simhash.near_duplicates(before).collect()}
            assert simhash.near_duplicates(kept).count() == 0
        if k == 2:
            assert substring.repeated_spans(kept).count() == 0
        if k == 3:
            assert was - ids == {x.doc_id for x in decontam.contaminated(before, bench).select("doc_id").collect()}
        if k == 4:
            n = {x.doc_id: x.n for x in before.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n")).collect()}
            assert {x.doc_id: x.n for x in kept.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == n


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
