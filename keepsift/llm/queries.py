"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from keepsift.llm import (
    bpe,
    divergence,
    exact_dedup,
    html_text,
    jaccard_join,
    merkle,
    packing,
    quality,
    secrets,
    sharding,
    substring_dedup,
    suffix_dedup,
    topk,
)
from keepsift.llm.sql import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).drop("spans")


@query
def op2_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.bpe_round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN))


@query
def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_groups(documents(spark, sf_dir)).drop("class_id")


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query
def op5_quality_classifier(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    return quality.grade_documents(docs, quality.fit(docs, graded))


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("spans")


@query
def op7_best_fit_packing(spark, sf_dir):
    # The rank file has the vocabulary of byte_bpe_50k.json; the tests compare the ids.
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.best_fit_packing(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query
def op8_sharding(spark, sf_dir):
    placed = sharding.interleaved_shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(documents(spark, sf_dir)).drop("found")


@query
def op10_top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(documents(spark, sf_dir))


@query
def op12_html_extraction(spark, sf_dir):
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op13_merkle_manifest(spark, sf_dir):
    docs, columns = documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.merkle_manifest(docs, columns, claimed=merkle.tampered(docs, columns, "doc_id", "text"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
