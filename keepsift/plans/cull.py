"""The whole culling run as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.operators.filters import split_face_limit
from keepsift.operators.grouping import group_duplicates, representatives
from keepsift.operators.inference import batch_tag
from keepsift.operators.joins import apply_weights, attach_keywords, unscored_assets
from keepsift.operators.naming import export_keepers
from keepsift.operators.rollups import face_rollup, shortfall_reasons
from keepsift.operators.sets import existing_plus_new
from keepsift.operators.tiers import apply_overrides, assign_tiers, fill_shortfall
from keepsift.session import store
from keepsift.settings import Settings
from keepsift.sinks.exports import sidecars
from keepsift.sources.listing import scan_assets


@dataclass
class Cull:
    members: DataFrame  # every scanned asset with its cluster
    scores: DataFrame  # every representative with scores and tier
    reasons: DataFrame  # one row of counters


def cull(
    files: DataFrame,
    faces: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    settings: Settings,
    fingerprint="fp",
    stored: DataFrame | None = None,
    overrides: DataFrame | None = None,
    recursive: bool | None = None,
) -> Cull:
    """Scan, drop near-duplicates, set over-limit assets aside, score the rest, tier, fill up.

    `files` is a listing with image_id and folder, `faces` one row per face. `score` adds the six
    dimensions, reasoning and whatever else it has to the assets it is given: it sees only
    representatives within the face limit that have no score in `stored` yet. What it returns is
    written down before it is read again. Sub-folders are read if they are processed one by one,
    or if `recursive` says so. A face row with an `error` counts as a failed detection.
    """
    scanned = scan_assets(
        files,
        settings.extension_filter,
        settings.prefix_filter,
        settings.prefix_any_case,
        settings.ignore_patterns,
        recursive=settings.process_subfolders if recursive is None else recursive,
    )
    members = store(
        group_duplicates(
            scanned,
            settings.duplicate_threshold,
            fingerprint,
            by=("folder",) if settings.process_subfolders else (),
            disabled=settings.disable_duplicate_grouping,
        ),
        "members",
    )
    reps = face_rollup(representatives(members), faces, settings.max_faces_per_image)
    fit, rejected = split_face_limit(reps, settings.max_faces_per_image)
    if stored is not None:
        rejected = unscored_assets(rejected, stored)
    todo = unscored_assets(fit, stored) if stored is not None else fit
    fresh = store(apply_weights(score(todo), settings.weights), "scores")
    everything = existing_plus_new(stored, rejected, fresh) if stored is not None else rejected.unionByName(
        fresh, allowMissingColumns=True
    )
    tiers = assign_tiers(everything, by=settings.tier_scope)
    if overrides is not None:
        tiers = apply_overrides(tiers, overrides)
    if settings.num_to_select > 0 and settings.shortfall_strategy != "stop":
        tiers = fill_shortfall(store(tiers, "tiers"), settings.num_to_select, settings.shortfall_strategy, settings.tier_scope)
    tiers = store(tiers, "tiers")
    failed = F.col("face_error") if "face_error" in tiers.columns else F.lit(None).cast("string")
    verdicts = tiers.select("image_id", "total", "tier", "exceeds_face_limit", failed.alias("face_error"))
    labelled = members.join(verdicts, "image_id", "left")
    return Cull(members, tiers, shortfall_reasons(labelled))


@dataclass
class Finished:
    scores: DataFrame  # with the keywords of the best keepers
    sidecars: DataFrame | None  # a document per score, for `write_sidecars`
    copies: DataFrame | None  # the copy plan of the keepers, for `copy_files`


def finish(
    run: Cull,
    settings: Settings,
    source_root: str,
    target_root: str,
    tag: Callable[[dict], object] | None = None,
    existing: DataFrame | None = None,
    **calls,
) -> Finished:
    """What follows the tiers: keywords for the best keepers, sidecar documents and the copy plan, as far as the
    settings ask for them. `calls` goes to the tagger (concurrency, sleep)."""
    scores = run.scores
    for name, kind in (("reasoning", "string"), ("keywords", "array<string>")):
        if name not in scores.columns:
            scores = scores.withColumn(name, F.lit(None).cast(kind))
    if settings.enable_auto_tagging and tag is not None:
        tags = batch_tag(scores, tag, settings.tag_top_percent, **calls)
        scores = store(attach_keywords(scores, tags), "tagged")
    documents = sidecars(scores, run.members) if settings.enable_sidecars else None
    copies = None
    if settings.export_mode == "copyToOutput":
        flat = not settings.preserve_subfolders
        copies = export_keepers(scores, source_root, target_root, preserve=not flat, **({"existing": existing} if flat else {}))
    return Finished(scores, documents, copies)
