"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral, numbered
from keepsift.session import store

SHARDS = 24
#: Bytes a row needs besides its text.
ROW_BYTES = 8


def interleaved_shards(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, shard, slot.

    Rows are shuffled within their source by a seeded digest of the id and ranked; (rank - 1/2) / rows of the
    source is the place at which a source spreads evenly. Sorting all rows by it and cutting into contiguous
    runs gives shards whose counts differ by one at most, overall and, up to rounding, for each source.
    Neither ranking puts a source or the whole table into one task (`numbered`); texts are never shuffled.

    Defined cases: a NULL text has no bytes and the CRC of the empty text; a NULL source is a source of its
    own; a NULL id is shuffled as a value of its own; rows that repeat id and text are told apart by place only.
    Empty tables give no rows; other columns are ignored.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    doc_id = integral(df, id_col)
    rows = df.select(
        doc_id.alias("doc_id"),
        df[source_col].cast("string").alias("source"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary")).alias("shuffled"),
    )
    order = ["shuffled", "doc_id", "text_crc32", "size"]
    ranked = numbered(rows, "rank", order, ["source"])
    ranked = store(ranked, "ranked")
    of_source = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("source", "named")
    spread = ranked.join(of_source, F.col("source").eqNullSafe(F.col("named"))).select(
        *ranked.columns, ((F.col("rank") + 0.5) / F.col("rows")).alias("fraction")
    )
    total = ranked.count()
    placed = numbered(spread, "place", ["fraction", *order])
    n = max(total, 1)
    return placed.withColumn("shard", F.expr(f"place * {shards} div {n}").cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "shard",
        F.expr(f"place - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"),
    )
