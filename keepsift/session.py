"""Session set-up and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keepsift", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for tables between stages: `spark.checkpoint.dir`.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="keepsift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


RUN_DIR = "keepsift.run.dir"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables that are stored meanwhile; it is removed at the end.

    Results that read them have to be written, or collected, before that.
    """
    path, before = f"{work_dir(spark)}/run-{uuid.uuid4().hex}", spark.conf.get(RUN_DIR, None)
    spark.conf.set(RUN_DIR, path)
    try:
        yield path
    finally:
        spark.conf.unset(RUN_DIR)
        if before:
            spark.conf.set(RUN_DIR, before)
        delete(spark, path)


def run_dir(spark: SparkSession) -> str:
    """Where tables go now: the run folder, or the shared folder itself."""
    return spark.conf.get(RUN_DIR, None) or work_dir(spark)


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would take for it, so that tasks reach the same place."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later stages then start from files that outlive any executor, and a value
    that depends on the partition (a partition id) is the same for every reader.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by key only where the scan has fewer partitions than the cluster has slots,
    as with a few large unsplittable files before heavy per-row work."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df
