"""A training corpus in five stages, each over what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` writes each result to
the shared folder and reads it again as the next stage's documents.  All
stages but the last return the columns of ``documents``.

A stage judges every row by its own id and text: rows that share an id, or
have none, stay or go each for itself, in every stage; of rows equal in both
the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import quality, queries, secrets, simhash, templates
from clausework.llm.common import load, without, written

# No SQL: the stages train models, walk trees and replay merges.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return without(docs, quality.score(docs).where("not kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id (null last, ties by the text's hash)."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, shingle=4, max_bits=4))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without(docs, templates.contaminated(docs, load(spark, sf_dir, "benchmark")))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a label, ``n_chars`` counted anew."""
    clean = secrets.redact(docs, secrets.scan(docs, queries.dictionary(spark)))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return queries.bpe_digests(docs)


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", deduplicate), ("benchmark_decontamination", decontaminate),
          ("secret_scan", scrub), ("byte_bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
