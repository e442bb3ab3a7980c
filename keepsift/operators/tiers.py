"""Tiering, shortfall filling and top-percent selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.operators.ranking import is_within, latest, top_cuts, top_rows, with_cuts


def tier_sizes(n: Column) -> dict[str, Column]:
    """Rows in S, in S+A and in S+A+B for a pool of n; the double formula, ceilings included."""
    s = F.greatest(F.lit(1), F.ceil(n * F.lit(K.TIER_SHARES["S"])))
    a = s + F.ceil(n * F.lit(K.TIER_SHARES["A"]))
    b = a + F.ceil(n * F.lit(K.TIER_SHARES["B"]))
    return {"S": s, "A": a, "B": b}


def assign_tiers(scores: DataFrame, by: Sequence[str] = (), exceeds: str | None = "exceeds_face_limit") -> DataFrame:
    """Set `tier` by percentile of `total` within each scope `by` (the whole session by default).

    Rows over the face limit do not count and keep the tier they have, "rejected" if none. Ties
    go to the smaller image_id. Totals below the floor are rejected afterwards.
    """
    out = F.col(exceeds) if exceeds and exceeds in scores.columns else F.lit(False)
    cuts = top_cuts(scores.where(~out), tier_sizes(F.col("n")), by=by)
    cuts = cuts.select(*by, *[F.col(t).alias(f"_cut_{t}") for t in ("S", "A", "B")])
    before = F.coalesce(F.col("_before"), F.lit("rejected"))
    tier = (
        F.when(out, before)
        .when(F.col("total") < K.QUALITY_FLOOR, "rejected")
        .when(is_within(F.col("_cut_S")), "S")
        .when(is_within(F.col("_cut_A")), "A")
        .when(is_within(F.col("_cut_B")), "B")
        .otherwise("rejected")
    )
    cols = [c for c in scores.columns if c != "tier"]
    had = F.col("tier") if "tier" in scores.columns else F.lit(None).cast("string")
    return with_cuts(scores.withColumn("_before", had).drop("tier"), cuts, by).select(*cols, tier.alias("tier"))


def keepers(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("tier").isin("S", "A"))


def below_floor(scores: DataFrame, exceeds: str = "exceeds_face_limit") -> DataFrame:
    return scores.where((F.col("total") < K.QUALITY_FLOOR) & ~F.col(exceeds))


def top_percent(scores: DataFrame, percent: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Best `percent` of the rows (at least one), percent held to 0..100."""
    p = max(0.0, min(100.0, float(K.TAG_TOP_PERCENT if percent is None else percent)))
    take = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p / 100)))
    return top_rows(scores, take, by=by)


def fill_shortfall(scores: DataFrame, target: int, strategy: str, by: Sequence[str] = ()) -> DataFrame:
    """Promote the best non-keepers to A until `target` keepers exist.

    `fillWithB` promotes B rows only, `fillWithRejected` B and rejected together, `stop` nobody.
    """
    if strategy not in ("stop", "fillWithB", "fillWithRejected"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "stop":
        return scores
    allowed = ("B",) if strategy == "fillWithB" else ("B", "rejected")
    is_candidate = F.col("tier").isin(*allowed)
    kept = scores.groupBy(*by).agg(F.count_if(F.col("tier").isin("S", "A")).alias("_kept"))
    cuts = top_cuts(
        scores.where(is_candidate), {"_cut": F.greatest(F.lit(0), F.lit(target) - F.col("_kept"))}, by=by, extra=kept
    )
    promoted = F.when(is_candidate & is_within(F.col("_cut")), "A").otherwise(F.col("tier"))
    cols = [promoted.alias("tier") if c == "tier" else F.col(c) for c in scores.columns]
    return with_cuts(scores, cuts, by).select(*cols)


def top_n(scores: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Optional hard cap on keepers; 0 keeps all."""
    return scores if n == 0 else top_rows(scores, F.lit(n), by=by)


def retier_after_rescore(scores: DataFrame, fresh: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    from keepsift.operators.joins import rescore_merge

    return assign_tiers(rescore_merge(scores, fresh), by=by)


def apply_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual tiers win over computed ones.

    `overrides(image_id, tier, seq, undone)` is a log; the newest entry per asset that is not
    undone counts. Entries for unknown assets or with an unknown tier change nothing.
    """
    valid = overrides.where(F.col("tier").isin(*K.TIERS) & ~F.col("undone"))
    last = latest(valid.select("image_id", "tier", "seq"), ["image_id"], ["seq"])
    last = last.select("image_id", F.col("tier").alias("_manual"))
    cols = [F.coalesce("_manual", "tier").alias("tier") if c == "tier" else F.col(c) for c in scores.columns]
    return scores.join(last, "image_id", "left").select(*cols)


def undo_stack(overrides: DataFrame, limit: int = K.UNDO_LIMIT) -> DataFrame:
    """The newest `limit` overrides, the ones that can still be undone."""
    return overrides.where(~F.col("undone")).orderBy(F.desc("seq")).limit(limit)
