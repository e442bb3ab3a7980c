"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from keepsift.session import store

#: The letters that contracts fold, no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as empty. Texts of one byte per character take the fast built-in."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of key columns in which NULL equals NULL; still a hash or sort-merge join key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def numbered(df: DataFrame, name: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Add `name`: place of the row from 0 in its group by `order` (a total order), whatever a group's size.

    Rows are range-partitioned on (group, order) and stored, so a large group spans many partitions;
    each partition ranks its own rows and adds what earlier partitions of the group hold. The sizes
    that are summed have one row for each partition and group that meet.
    """
    by = group or []
    placed = store(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), f"placed-{name}")
    sizes = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_rows")
    carry = sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in by], before.alias("_before"))
    local = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)) - 1)
    cond = F.col("_part") == F.col("_p")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = local.join(carry, cond)
    return out.select(*df.columns, (F.col("_rank") + F.col("_before")).cast("long").alias(name))


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most this many bytes (a longer row is a batch of its own) for what is run meanwhile.

    The session has its own setting back afterwards. A smaller one of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_before = spark.conf.get(key, None)
    own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_before)) if set_before else most
    if 0 < own < most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)
        if set_before and spark.conf.get(key, None) != set_before:
            spark.conf.set(key, set_before)


@contextmanager
def reader_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Parquet is read at most this many rows at a time for what is run meanwhile: a task holds as many whole texts.

    The session has its own setting back afterwards. A smaller one of the session stays.
    """
    key = "spark.sql.parquet.columnarReaderBatchSize"
    set_before = spark.conf.get(key, None)
    if set_before and int(set_before) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)
        if set_before and spark.conf.get(key, None) != set_before:
            spark.conf.set(key, set_before)


def integral(df: DataFrame, column: str) -> Column:
    """The id column as BIGINT."""
    return df[column].cast(T.LongType())
