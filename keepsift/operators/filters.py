"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions import paths as P
from keepsift.functions.text import seconds_between

def filter_extensions(files: DataFrame, extensions: Sequence[str] = (), name: str = "filename") -> DataFrame:
    """Files with one of the extensions, any case; none given means all supported ones."""
    wanted = [e.lower() for e in extensions] or list(K.SUPPORTED_EXTENSIONS)
    return files.where(F.lower(P.extension(F.col(name))).isin(*wanted))


def has_prefix(name: Column, prefixes: Sequence[str], any_case: bool = True) -> Column:
    if not prefixes:
        return F.lit(True)
    tested = F.lower(name) if any_case else name
    return reduce(
        lambda a, b: a | b, [tested.startswith(p.lower() if any_case else p) for p in prefixes]
    )


def filter_prefixes(files: DataFrame, prefixes: Sequence[str] = (), any_case: bool = True, name="filename") -> DataFrame:
    return files.where(has_prefix(F.col(name), prefixes, any_case))


def is_ignored(relative_path: Column, patterns: Sequence[str]) -> Column:
    return relative_path.rlike(P.ignore_regex(list(patterns))) if patterns else F.lit(False)


def filter_ignored(files: DataFrame, patterns: Sequence[str], relative_path: str = "relative_path") -> DataFrame:
    return files.where(~is_ignored(F.col(relative_path), patterns))


def is_hidden(relative_path: Column, skipped_dirs: Sequence[str] = ()) -> Column:
    """A segment starts with a dot, is a junk name, or is a directory that is never entered."""
    junk = [f"(?:{'|'.join(n.replace('.', chr(92) + '.') for n in K.JUNK_NAMES)})(?:/|$)"]
    dirs = [f"(?:{'|'.join(d.replace('.', chr(92) + '.') for d in skipped_dirs)})/"] if skipped_dirs else []
    return relative_path.rlike("(?:^|/)(?:" + "|".join([r"\.", *junk, *dirs]) + ")")


def filter_hidden(files: DataFrame, relative_path: str = "relative_path", skipped_dirs: Sequence[str] = ()) -> DataFrame:
    return files.where(~is_hidden(F.col(relative_path), skipped_dirs))


def filter_supported(files: DataFrame, name: str = "filename") -> DataFrame:
    return files.where(P.is_supported(F.col(name)))


def flag_face_limit(assets: DataFrame, limit: int, count: str = "face_count") -> DataFrame:
    over = (F.col(count) > limit) if limit > 0 else F.lit(False)
    return assets.withColumn("exceeds_face_limit", over)


def split_face_limit(assets: DataFrame, limit: int, count: str = "face_count") -> tuple[DataFrame, DataFrame]:
    """(scorable, rejected): rejected rows come with zero scores and the reason."""
    flagged = flag_face_limit(assets, limit, count)
    reason = F.concat(
        F.lit("Auto-rejected: "),
        F.col(count).cast("string"),
        F.lit(f" faces detected, limit is {limit}."),
    )
    rejected = flagged.where("exceeds_face_limit").withColumns(
        {
            **{d: F.lit(0) for d in K.DIMENSIONS},
            "total": F.lit(0.0),
            "tier": F.lit("rejected"),
            "reasoning": reason,
        }
    )
    return flagged.where(~F.col("exceeds_face_limit")), rejected


def by_tier(scores: DataFrame, *tiers: str) -> DataFrame:
    return scores.where(F.col("tier").isin(*(tiers or ("S", "A"))))


def is_expired(cached_at: Column, now: Column, max_age_days: float) -> Column:
    return seconds_between(cached_at, now) > max_age_days * 86400


def expired(entries: DataFrame, now: Column, max_age_days: float, cached_at: str = "cached_at") -> DataFrame:
    return entries.where(is_expired(F.col(cached_at), now, max_age_days))


def compare_assets(scores: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(dimension, image_id, value) of two to four assets, one row per pair."""
    if not 2 <= len(set(ids)) <= 4:
        raise ValueError("choose two to four assets")
    chosen = scores.where(F.col("image_id").isin(*ids))
    return chosen.select("image_id", *[F.col(d).cast("bigint").alias(d) for d in K.DIMENSIONS]).unpivot(
        "image_id", list(K.DIMENSIONS), "dimension", "value"
    )


def violations(df: DataFrame, rules: Mapping[str, Column], out: str = "violations") -> DataFrame:
    """Names of the rules a row breaks; a rule that is NULL counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    return df.withColumn(out, F.array_compact(broken))


def settings_rules() -> dict[str, Column]:
    """Rules for rows of job settings. Optional fields may be NULL."""

    def within(name, low, high, optional=False):
        ok = F.col(name).between(low, high)
        return (F.col(name).isNull() | ok) if optional else ok

    def filled(name):
        return F.length(F.col(name)) >= 1

    return {
        "input_folder": filled("input_folder"),
        "output_folder": filled("output_folder"),
        "num_to_select": within("num_to_select", 0, 999),
        "genre": F.col("genre").isin(*K.GENRE_PRESETS),
        **{d: within(d, 0, 100) for d in K.DIMENSIONS},
        "provider": F.col("provider").isin(*K.PROVIDER_PRICES),
        "model": filled("model"),
        "concurrency": within("concurrency", 1, 10),
        "shortfall_strategy": F.col("shortfall_strategy").isin("stop", "fillWithB", "fillWithRejected"),
        "export_mode": F.col("export_mode").isin("rateInPlace", "copyToOutput"),
        "duplicate_threshold": within("duplicate_threshold", 5, 20, optional=True),
        "cache_max_gb": within("cache_max_gb", 1, 50),
        "cache_max_days": within("cache_max_days", 1, 365),
        "tag_top_percent": within("tag_top_percent", 10, 100, optional=True),
    }


def valid_jpeg(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 2) == F.unhex(F.lit("FFD8")), F.lit(False))


def choose_preview(path: Column, width: Column, height: Column, has_embedded: Column, use_embedded: bool = True) -> Column:
    """passthrough, embedded or decoded. An embedded preview needs both sides of at least
    1024 px, or an unknown size. For scoring pass use_embedded=False."""
    big = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0) | (
        F.least(width, height) >= K.PREVIEW_MAX_PX
    )
    use = F.lit(use_embedded) & F.coalesce(has_embedded, F.lit(False)) & big
    return F.when(~P.is_raw(path), "passthrough").when(use, "embedded").otherwise("decoded")


def filter_model_catalog(
    catalog: DataFrame,
    contains: str | None = None,
    prefixes: Sequence[str] = (),
    method: str | None = None,
    name: str = "model",
    methods: str = "methods",
) -> DataFrame:
    """Catalogue rows by substring, prefix list (any case) or supported method."""
    out = catalog.where(F.col(name).isNotNull() & (F.col(name) != ""))
    if method:
        out = out.where(F.array_contains(methods, method))
    if contains:
        out = out.where(F.col(name).contains(contains))
    return filter_prefixes(out, prefixes, True, name)


def maintenance_due(last_run: Column, now: Column) -> Column:
    """Due a week after the last run; an unreadable or missing time is due at once."""
    last = last_run.try_cast("timestamp_ntz")
    return F.coalesce(seconds_between(last, now) >= K.MAINTENANCE_DAYS * 86400, F.lit(True))


def is_fresh(fetched_at: Column, now: Column, ttl_seconds: int = K.MODEL_TTL_SECONDS) -> Column:
    return seconds_between(fetched_at, now) < ttl_seconds


def size_cap(files: DataFrame, limit: int = K.MAX_BASE64_BYTES, length: str = "length") -> DataFrame:
    """Keep every row, with the reason where a file is too large to be inlined."""
    return files.withColumn("refused", F.when(F.col(length) > limit, f"larger than {limit} bytes"))


def as_base64(files: DataFrame, limit: int = K.MAX_BASE64_BYTES, content: str = "content") -> DataFrame:
    return size_cap(files, limit).withColumn("base64", F.when(F.col("refused").isNull(), F.base64(content)))


def resume_action(status: Column, scored: Column) -> Column:
    return F.when(status == "completed", "show_results").when(scored > 0, "offer_resume").otherwise("start")
