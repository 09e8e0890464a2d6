"""A training corpus in five stages, each over all that the one before has kept.

quality: documents that the quality classifier rejects go.
near duplicates: of each group of linked documents the one with the smallest id stays.
decontamination: documents that hold a benchmark item go.
secrets: every secret in a text is replaced by a mark; n_chars follows.
tokens: the ids of each text and their digests.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns of
documents, and each begins by having executors give back the heap that the one before has grown. Nulls, empty texts, ties, repeated rows and empty tables are each
operator's; a document with an empty text is kept if the quality score allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.bpe import encode
from lociframe.llm.decontam import contaminated
from lociframe.llm.ngram_join import jaccard_components
from lociframe.llm.quality_cnn import keep_good
from lociframe.llm.secrets import redact
from lociframe.llm.shared import give_back, materialize, small_batches, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    small_batches(spark)
    groups = jaccard_components(docs)
    return without(docs, groups.where("doc_id != component_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    small_batches(spark)
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "doc_id")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    small_batches(spark)
    return encode(docs, keep_ids=True, block_bytes=5 << 20)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: No SQL says what a trained network, a tokenizer or a graph's components do; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
