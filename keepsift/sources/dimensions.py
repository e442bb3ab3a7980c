"""Small fixed tables. Their sizes are known (2 to 7 rows), so joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsift import constants as K


def presets(spark: SparkSession) -> DataFrame:
    rows = [(g, *w) for g, w in K.GENRE_PRESETS.items()]
    return spark.createDataFrame(rows, "genre string, " + ", ".join(f"w_{d} int" for d in K.DIMENSIONS))


def prices(spark: SparkSession) -> DataFrame:
    rows = [(p, *c) for p, c in K.PROVIDER_PRICES.items()]
    return spark.createDataFrame(rows, "provider string, price_in double, price_out double")


def provider_defaults(spark: SparkSession) -> DataFrame:
    rows = [(p, *c) for p, c in K.PROVIDER_DEFAULTS.items()]
    return spark.createDataFrame(rows, "provider string, base_url string, default_model string")


def tier_limits(spark: SparkSession) -> DataFrame:
    rows = [(t, K.TIER_LIMITS[t], K.TIER_RANKS[t]) for t in K.TIER_LIMITS]
    return spark.createDataFrame(rows, "tier string, monthly_limit bigint, tier_rank int")


def features(spark: SparkSession) -> DataFrame:
    rows = [(i, f, K.TIER_RANKS[t]) for i, (f, t) in enumerate(K.FEATURE_TIERS.items())]
    return spark.createDataFrame(rows, "feature_no int, feature string, min_rank int")


def entitlements(spark: SparkSession) -> DataFrame:
    """(tier, feature_no, feature) for every feature a tier's rank reaches: at most 15 rows."""
    return (
        tier_limits(spark)
        .join(F.broadcast(features(spark)), F.col("tier_rank") >= F.col("min_rank"))
        .select("tier", "feature_no", "feature")
    )
