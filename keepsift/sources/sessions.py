"""Stored sessions, profiles and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsift import model as M
from keepsift.functions import paths as P

CORRUPT = "_corrupt"


def read_session(spark: SparkSession, folder: str, main: str = "session.json", backup: str = "session.backup.json") -> DataFrame:
    """Session documents below `folder`: the main file where it parses, else its backup."""
    schema = T.StructType(M.SESSION.fields + [T.StructField(CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{{{main},{backup}}}")
        .json(folder)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    ok = docs.where(F.col(CORRUPT).isNull() & F.col("sessionId").isNotNull())
    ranked = ok.withColumns(
        {"_dir": P.dirname(F.col("_file")), "_rank": (P.basename(F.col("_file")) != main).cast("int")}
    )
    best = ranked.groupBy("_dir").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["_dir", "_rank"]).select(*M.SESSION.fieldNames())


def session_scores(sessions: DataFrame) -> DataFrame:
    """One row per score of the sessions."""
    rows = sessions.select("sessionId", F.explode("scores").alias("image_id", "r"))
    return rows.select(
        F.col("sessionId").alias("session_id"),
        "image_id",
        "r.filename",
        "r.scores.*",
        "r.total",
        "r.tier",
        "r.reasoning",
        "r.keywords",
        F.col("r.usage.inputTokens").alias("tokens_in"),
        F.col("r.usage.outputTokens").alias("tokens_out"),
        F.col("r.thumbnailPath").alias("thumbnail_path"),
        F.coalesce("r.faceMetadata.exceedsFaceLimit", F.lit(False)).alias("exceeds_face_limit"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(M.PROFILE).json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(M.HISTORY).json(path)
