"""Joins of assets, scores, caches and small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions.numbers import token_cost, weighted_total
from keepsift.sources import dimensions as D


def unscored_assets(assets: DataFrame, scores: DataFrame, key: str = "image_id") -> DataFrame:
    """What a resumed run still has to score."""
    return assets.join(scores.select(key), key, "left_anti")


def cache_lookup(assets: DataFrame, cache: DataFrame, disabled: bool = False) -> DataFrame:
    """Add `cache_hit`. The key covers path and mtime, so a changed file misses; so does an
    entry that is not a JPEG (cache column `is_valid`)."""
    if disabled:
        return assets.withColumn("cache_hit", F.lit(False))
    hits = cache.where("is_valid").select("cache_key", F.lit(True).alias("_hit")).distinct()
    return assets.join(hits, "cache_key", "left").select(
        *assets.columns, F.coalesce("_hit", F.lit(False)).alias("cache_hit")
    )


def apply_weights(scores: DataFrame, weights: dict[str, float], out: str = "total") -> DataFrame:
    """Total with one weight set for all rows."""
    return scores.withColumn(out, weighted_total(F.col, lambda d: F.lit(float(weights[d]))))


def apply_preset(scores: DataFrame, genre: str = "genre", out: str = "total") -> DataFrame:
    """Total with the preset of each row's genre. Unknown genres give NULL."""
    table = F.broadcast(D.presets(scores.sparkSession)).withColumnRenamed("genre", "_g")
    joined = scores.join(table, F.col(genre) == F.col("_g"), "left")
    return joined.select(*scores.columns, weighted_total(F.col, lambda d: F.col(f"w_{d}")).alias(out))


def all_preset_totals(scores: DataFrame) -> DataFrame:
    """What-if: each row under all seven presets (genre, total). The presets are literals of the
    projection, so no join is needed."""
    cases = F.array(
        *[
            F.struct(
                F.lit(g).alias("genre"),
                weighted_total(F.col, lambda d, w=w: F.lit(float(w[K.DIMENSIONS.index(d)]))).alias("total"),
            )
            for g, w in K.GENRE_PRESETS.items()
        ]
    )
    return scores.select("image_id", F.inline(cases))


def price_lookup(usage: DataFrame, provider: str = "provider") -> DataFrame:
    """Add `cost` from tokens_in and tokens_out; unknown providers cost 0."""
    table = F.broadcast(D.prices(usage.sparkSession)).withColumnRenamed("provider", "_p")
    zero = F.lit(0.0)
    return usage.join(table, F.col(provider) == F.col("_p"), "left").select(
        *usage.columns,
        token_cost(
            F.col("tokens_in"), F.col("tokens_out"), F.coalesce("price_in", zero), F.coalesce("price_out", zero)
        ).alias("cost"),
    )


def attach_keywords(scores: DataFrame, keywords: DataFrame, key: str = "image_id") -> DataFrame:
    new = keywords.select(key, F.col("keywords").alias("_new"))
    cols = [F.coalesce("_new", "keywords").alias("keywords") if c == "keywords" else F.col(c) for c in scores.columns]
    return scores.join(new, key, "left").select(*cols)


def with_payload(scores: DataFrame, payload: DataFrame, key: str = "image_id") -> DataFrame:
    """Only rows whose bytes are at hand, with the bytes."""
    return scores.join(payload.where(F.col("content").isNotNull()), key)


def rescore_merge(old: DataFrame, fresh: DataFrame, key: str = "image_id", keep: Sequence[str] = ("thumbnail_path", "keywords")) -> DataFrame:
    """Fresh rows replace old ones of the same id; columns in `keep` stay. Unknown ids are left out."""
    changed = [c for c in fresh.columns if c != key and c in old.columns and c not in keep]
    new = fresh.select(key, F.lit(True).alias("_is_new"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    cols = [
        F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in old.columns
    ]
    return old.join(new, key, "left").select(*cols)


def resolve_paths(scores: DataFrame, assets: DataFrame, key: str = "image_id") -> DataFrame:
    """Add `path` and, where there is none, `error`. By id, as file names repeat between folders."""
    found = scores.drop("path").join(assets.select(key, "path"), key, "left")
    return found.withColumn("error", F.when(F.col("path").isNull(), "no path for this asset"))


def entitled(users: DataFrame, tier: str = "tier") -> DataFrame:
    """(user columns, feature) for every feature the user's tier allows."""
    table = F.broadcast(D.entitlements(users.sparkSession)).withColumnRenamed("tier", "_t")
    return users.join(table, F.col(tier) == F.col("_t")).drop("_t")


def allowed_features(users: DataFrame, tier: str = "tier") -> DataFrame:
    """Feature list per user; the list is a literal of at most five names."""
    allowed = F.lit(None).cast("array<string>")
    for t, rank in K.TIER_RANKS.items():
        names = [f for f, need in K.FEATURE_TIERS.items() if K.TIER_RANKS[need] <= rank]
        allowed = F.when(F.col(tier) == t, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(allowed)
    return users.withColumn("features", allowed)


def orphan_caches(caches: DataFrame, folders: DataFrame, key: str = "folder") -> DataFrame:
    return caches.join(folders.select(key), key, "left_anti")


def profile_name(sessions: DataFrame, profiles: DataFrame) -> DataFrame:
    names = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"))
    return sessions.join(names, "profile_id", "left")
