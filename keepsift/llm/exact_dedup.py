"""Exact deduplication by skew-safe combining: locally, by salted digest groups, then over the salts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral, lower_ascii
from keepsift.session import store

#: Reducers that share the copies of one text. Tasks combine their own copies first: one row per text and task.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Every grouping compares (digest, text), never the
    digest alone: map tasks combine their own copies, salted groups merge them, and the winners of the salts
    are merged last. Rows then look up their group by digest; digests that stand for several texts (possible
    with a weak `digest`) are looked up by the text as well.

    Defined cases: a NULL text is the empty text. A NULL id never wins over another id; a group of NULL ids has
    keep_id NULL and its rows are kept. Rows that repeat id and text all count and carry the same verdict.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = lower_ascii(df[text_col])
    rows = df.select(integral(df, id_col).alias("doc_id"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))

    # The rows of a task share a salt, so that all its copies of a text meet before the shuffle. Any salt is right.
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = (
        merged.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    by_digest = store(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "copies",
    )
    out = rows.select("doc_id", "digest", sha256(F.col("norm")).alias("text_sha256")).join(
        by_digest.where("texts = 1"), "digest"
    )
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    out = out.select(*columns)

    several = by_digest.where("texts > 1").select("digest")
    if several.isEmpty():
        return out
    met = rows.join(several, "digest", "left_semi")
    apart = met.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = met.join(apart, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm")))
    return out.unionByName(met.select(*columns))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, all columns as they are; of rows that repeat id and text one stays."""
    kept = store(exact_dedup(df, id_col, text_col).where("kept").select("doc_id", "text_sha256"), "kept")
    # The row as one column, so that no column of its own can be mistaken for those added here.
    marked = df.select(F.struct(*df.columns).alias("row"), integral(df, id_col).alias("id"), sha256(lower_ascii(df[text_col])).alias("sha"))
    repeated = kept.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        marked = marked.dropDuplicates(["id", "sha"])
        kept = kept.distinct()
    wanted = marked["id"].eqNullSafe(kept["doc_id"]) & (marked["sha"] == kept["text_sha256"])
    return marked.join(kept, wanted, "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
