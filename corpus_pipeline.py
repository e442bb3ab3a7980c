"""The documents that are worth training on, packed into sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsift.llm import exact_dedup, jaccard_join, packing, quality, secrets
from keepsift.llm.common import batch_bytes, reader_rows, same
from keepsift.session import store


def small_batches(stage: Callable) -> Callable:
    """A stage that hands texts to Python a few at a time, whoever calls it. That holds for what the stage itself runs or
    stores: what it leaves to be run later has the session's own batches, so no texts may go to Python there."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with batch_bytes(spark, jaccard_join.BATCH_BYTES), reader_rows(spark, jaccard_join.READ_ROWS):
            return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is a half or more; the others, junk and toxic ones, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    return store(quality.good_documents(docs, quality.fit(docs, graded)), "good")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the smallest id; rows without an id are in no group."""
    groups = jaccard_join.jaccard_groups(docs)
    kept = groups.where("component_id IS NULL OR doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, same(docs, kept, "doc_id"), "left_semi")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.best_fit_packing(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot fit the classifier or tokenise; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not quality_classifier:  # it has stored its result
            docs = store(docs, f"stage-{name.replace(' ', '-')}")
    return docs
