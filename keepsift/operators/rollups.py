"""Aggregates over assets, scores, caches, usage and job metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import faces as A
from keepsift.functions import paths as P
from keepsift.functions.numbers import estimate_cost, js_round, percent_of
from keepsift.operators.filters import has_prefix, is_hidden, is_ignored, violations  # noqa: F401
from keepsift.sources import dimensions as D


def tier_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, rows per tier and their rounded percentages, in one pass."""
    total = F.count(F.lit(1))
    per = {t: F.count_if(F.col("tier") == t) for t in K.TIERS}
    return scores.groupBy(*by).agg(
        total.alias("total"),
        *[c.alias(f"n_{t}") for t, c in per.items()],
        *[percent_of(c, total).alias(f"pct_{t}") for t, c in per.items()],
    )


def token_cost_totals(scores: DataFrame, by: Sequence[str] = ("provider",)) -> DataFrame:
    """Token sums and cost per provider."""
    sums = scores.groupBy(*by).agg(
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
    )
    return sums.withColumn("cost", estimate_cost(F.col("provider"), F.col("tokens_in"), F.col("tokens_out")))


def extension_counts(files: DataFrame) -> DataFrame:
    """Files per lower-cased extension without hidden ones, and whether the type is supported."""
    return (
        files.where(~is_hidden(F.col("relative_path")))
        .groupBy(F.lower(P.extension(F.col("filename"))).alias("extension"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("extension <> ''")
        .withColumn("supported", F.col("extension").isin(*K.SUPPORTED_EXTENSIONS))
    )


def prefix_count(files: DataFrame, prefixes: Sequence[str], any_case: bool = True) -> DataFrame:
    return files.agg(F.count_if(has_prefix(F.col("filename"), prefixes, any_case)).alias("n"))


def scan_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n"))


def ignored_count(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Files an ignore list removes, in one pass over the listing."""
    return files.agg(F.count_if(is_ignored(F.col("relative_path"), patterns)).alias("ignored"))


def shortfall_reasons(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Why fewer keepers than hoped: counts over all assets, suppressed duplicates included.

    Columns used: is_representative, exceeds_face_limit, face_error, total and tier (both NULL
    for duplicates).
    """
    dup = ~F.col("is_representative")
    rep = F.col("is_representative")
    duplicates = F.count_if(dup)
    return labelled.groupBy(*by).agg(
        duplicates.alias("duplicates_skipped"),
        F.count_if(rep & (F.col("total") < K.QUALITY_FLOOR) & ~F.col("exceeds_face_limit")).alias("below_threshold"),
        F.count_if(rep & F.col("face_error").isNotNull()).alias("face_detection_failed"),
        F.count_if(rep & F.col("exceeds_face_limit")).alias("exceeded_face_limit"),
        duplicates.alias("burst_grouped"),
        F.count_if(rep & F.col("tier").isin("S", "A")).alias("final_selected"),
        F.count_if(rep & (F.col("tier") == "S")).alias("selected_s"),
    )


def top_score(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(js_round(F.coalesce(F.max("total"), F.lit(0.0)), 2).alias("top_score"))


def face_rollup(assets: DataFrame, faces: DataFrame, limit: int = 0) -> DataFrame:
    """Per asset: face count, eyes, blink, expression. Assets without faces get the defaults, and
    so do those whose detection failed; `face_error` then tells why.

    Boxes stay in their own table (`face_boxes`): one asset's faces need not fit an array.
    """
    error = F.col("error") if "error" in faces.columns else F.lit(None).cast("string")
    faces = faces.withColumn("_error", error)
    for c in ("left_open", "right_open", "emotion"):
        faces = faces.withColumn(c, F.when(F.col("_error").isNull(), F.col(c)))
    found = F.col("_error").isNull()
    per = faces.groupBy("image_id").agg(
        F.count_if(found).alias("_n"),
        F.max("_error").alias("_error"),
        F.bool_and(F.when(found, A.eyes_open(F.col("left_open"), F.col("right_open")))).alias("_open"),
        F.bool_or(F.when(found, A.blinks(F.col("left_open"), F.col("right_open")))).alias("_blink"),
        F.bool_and(F.when(found, A.is_neutral(F.col("emotion")))).alias("_neutral"),
    )
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return assets.join(per, "image_id", "left").select(
        *assets.columns,
        (n > 0).alias("has_faces"),
        n.alias("face_count"),
        F.coalesce("_open", F.lit(True)).alias("eyes_open"),
        F.coalesce("_blink", F.lit(False)).alias("blink_detected"),
        F.coalesce("_neutral", F.lit(True)).alias("expression_neutral"),
        ((n > limit) if limit > 0 else F.lit(False)).alias("exceeds_face_limit"),
        F.col("_error").alias("face_error"),
    )


def face_boxes(faces: DataFrame) -> DataFrame:
    """(image_id, face_no, x, y, width, height) as fractions of the image."""
    box = A.normalise_box(F.col("box"), F.col("image_width"), F.col("image_height"))
    return faces.select("image_id", "face_no", box.alias("b")).select("image_id", "face_no", "b.*")


def cache_stats(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return entries.groupBy(*by).agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.min("cached_at").alias("oldest_entry"),
    )


def cleanup_totals(evicted: DataFrame) -> DataFrame:
    """Deleted files and freed bytes per folder, with the grand total under a NULL folder."""
    return evicted.rollup("folder").agg(
        F.count(F.lit(1)).alias("deleted_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("freed_bytes")
    )


def folder_rollup(scores: DataFrame, by: Sequence[str] = ("folder",)) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("total").isNotNull()).alias("scored"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"),
    )


def preflight(files: DataFrame, kept: Column, quota_left: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Error code or warning for a listing. `kept` says which rows pass all filters; a quota
    of None is unlimited. A partly sufficient quota only warns."""
    checks = files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(P.is_supported(F.col("filename"))).alias("supported"),
        F.count_if(kept).alias("selected"),
    )
    code = (
        F.when(F.col("files") == 0, "NO_IMAGES_FOUND")
        .when(F.col("supported") == 0, "UNSUPPORTED_FORMATS_ONLY")
        .when(F.col("selected") == 0, "NO_IMAGES_FOUND")
    )
    warning = F.lit(None).cast("string")
    if quota_left is not None:
        code = code.when(F.lit(quota_left <= 0), "FREE_LIMIT_EXCEEDED")
        warning = F.when(
            (F.col("selected") > quota_left) & F.lit(quota_left > 0),
            F.concat(F.lit(f"only {quota_left} of "), F.col("selected").cast("string"), F.lit(" allowed")),
        )
    return checks.withColumns({"code": code, "warning": warning})


def usage_status(usage: DataFrame, users: DataFrame, month: str) -> DataFrame:
    """Used, limit and remaining per user for a month; -1 means unlimited. Another month starts at 0."""
    used = usage.where(F.col("month_key") == month).groupBy("user_id").agg(F.sum("n").alias("_used"))
    limits = F.broadcast(D.tier_limits(users.sparkSession).select("tier", "monthly_limit"))
    limit = F.coalesce("monthly_limit", F.lit(-1)).cast("bigint")
    current = F.coalesce("_used", F.lit(0)).cast("bigint")
    return (
        users.join(limits, "tier", "left")
        .join(used, "user_id", "left")
        .select(
            "user_id",
            "tier",
            current.alias("current"),
            limit.alias("limit"),
            F.when(limit == -1, F.lit(-1)).otherwise(F.greatest(F.lit(0), limit - current)).cast("bigint").alias(
                "remaining"
            ),
        )
    )


def quota_check(status: DataFrame, requested: str = "requested") -> DataFrame:
    """allowed, partial or exceeded for a request against `usage_status` rows."""
    left, want = F.col("remaining"), F.col(requested)
    unlimited = F.col("limit") == -1
    state = (
        F.when(unlimited | ((left > 0) & (want <= left)), "allowed").when(left > 0, "partial").otherwise("exceeded")
    )
    after = F.when(unlimited, F.lit(-1)).when(left <= 0, F.lit(0)).when(want > left, left).otherwise(left - want)
    return status.withColumns({"quota": state, "remaining_after": after.cast("bigint")})


def no_faces_flag(rows: DataFrame, face_weight: float, by: Sequence[str] = ()) -> DataFrame:
    flag = F.lit(face_weight > 0) & (F.count(F.lit(1)) > 0) & ~F.coalesce(
        F.bool_or(F.col("face_count") > 0), F.lit(False)
    )
    return rows.groupBy(*by).agg(flag.alias("no_faces"))


def timing_by_format(runs: DataFrame) -> DataFrame:
    """Whole milliseconds of passed rows per extension, and pass/fail counts."""
    passed = F.col("passed")
    ms = F.when(passed, F.col("ms"))
    return runs.groupBy("extension").agg(
        F.sum(ms).alias("sum_ms"),
        (F.sum(ms) / F.count(ms)).alias("avg_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
    )


def stage_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("stage").agg(
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("items").alias("items"),
        F.sum("successes").alias("successes"),
        (F.sum("items") - F.sum("successes")).alias("failures"),
        F.max("memory_bytes").alias("peak_memory_bytes"),
    )


def dry_run_estimate(files: DataFrame, provider: str, select_n: int, by: Sequence[str] = ()) -> DataFrame:
    """Tokens, cost, expected keepers and shortfall range from the number of files alone."""
    n = F.col("files")
    t_in, t_out = (n * t for t in K.TOKENS_PER_ITEM)
    low, high = js_round(n * F.lit(0.8)), js_round(n * F.lit(0.9))

    def short(expected):
        return F.greatest(F.lit(0), F.lit(select_n) - expected) if select_n > 0 else F.lit(0)

    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files")).withColumns(
        {
            "tokens_in": t_in.cast("bigint"),
            "tokens_out": t_out.cast("bigint"),
            "cost": estimate_cost(F.lit(provider), t_in, t_out),
            "keepers_min": low.cast("bigint"),
            "keepers_max": high.cast("bigint"),
            "shortfall_min": short(high).cast("bigint"),
            "shortfall_max": short(low).cast("bigint"),
        }
    )


def dir_size(files: DataFrame, root: str) -> DataFrame:
    below = F.col("path").startswith(root.rstrip("/") + "/")
    return files.where(below).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def processed_skipped(loaded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return loaded.groupBy(*by).agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("skipped")
    )


def resume_estimate(sessions: DataFrame) -> DataFrame:
    """Items, minutes and cost an unfinished session has left; 5 s per item when untimed."""
    left = F.col("total_images") - F.col("scored_count")
    avg = F.col("elapsed_ms") / F.col("scored_count")
    per_item = F.when(avg > 0, avg).otherwise(F.lit(float(K.UNKNOWN_ITEM_MS)))
    return sessions.withColumns(
        {
            "remaining": left,
            "remaining_minutes": F.ceil(left * per_item / 60000.0).cast("bigint"),
            "remaining_cost": estimate_cost(
                F.col("provider"), left * K.TOKENS_PER_ITEM[0], left * K.TOKENS_PER_ITEM[1]
            ),
        }
    )


def profile_limit(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Whether a user may save one more profile: the free tier holds two."""
    held = profiles.groupBy("user_id").agg(F.count(F.lit(1)).alias("_held"))
    n = F.coalesce("_held", F.lit(0)).cast("bigint")
    ok = (F.col("tier") != "free") | (n < K.FREE_PROFILE_LIMIT)
    return users.join(held, "user_id", "left").select("user_id", "tier", n.alias("profiles"), ok.alias("may_add"))
