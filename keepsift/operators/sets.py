"""Unions, merges and upserts of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.operators.ranking import latest
from keepsift.operators.tiers import assign_tiers


def split_union(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tier the scorable rows and put the pre-rejected ones back unchanged."""
    out = F.col("exceeds_face_limit")
    return assign_tiers(scores.where(~out), by=by, exceeds=None).unionByName(scores.where(out), allowMissingColumns=True)


def existing_plus_new(existing: DataFrame, rejected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Everything the tiering sees in a resumed run."""
    return existing.unionByName(rejected, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


def merge_sessions(scores: DataFrame, key: str = "image_id", batch: str = "batch_no") -> DataFrame:
    """One row per asset from several batches; the later batch wins."""
    return latest(scores, [key], [batch])


def merge_session_heads(heads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First batch's identity with totals and elapsed time added up."""
    return heads.groupBy(*by).agg(
        F.min_by("session_id", "batch_no").alias("session_id"),
        F.sum("total_images").alias("total_images"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"),
        F.count(F.lit(1)).alias("batches"),
    )


def upsert_scores(log: DataFrame, key: Sequence[str] = ("session_id", "image_id"), newest: Sequence[str] = ("seq",)) -> DataFrame:
    """Current state of an append-only score log: last write per key."""
    return latest(log, list(key), list(newest))


def upsert_profiles(profiles: DataFrame, new: DataFrame, required: Sequence[str] = ("id", "name", "genre")) -> DataFrame:
    """Replace by id or append. Rows without a required field are refused."""
    valid = new
    for c in required:
        valid = valid.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return profiles.join(valid.select("id"), "id", "left_anti").unionByName(valid)


def delete_profiles(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    return profiles.join(ids.select("id"), "id", "left_anti")


def session_state(events: DataFrame) -> DataFrame:
    """Latest value per session and field of session_events(session_id, seq, field, value).
    Clearing a session removes all that came before; a session with nothing after it is left out."""
    fields = ("status", "context", "total_images", "scored_count")
    newest = [F.max(F.when(F.col("field") == f, F.struct("seq", "value"))).alias(f) for f in fields]
    cleared = F.max(F.when(F.col("field") == "cleared", F.col("seq"))).alias("_cleared")
    wide = events.groupBy("session_id").agg(*newest, cleared, F.max("seq").alias("_last"))
    after = F.coalesce(F.col("_cleared"), F.lit(-(2**63)))
    wide = wide.where(F.col("_last") > after)
    # The newest value of a field counts if it came after the newest clearing.
    return wide.select("session_id", *[F.when(F.col(f)["seq"] > after, F.col(f)["value"]).alias(f) for f in fields])


def append_history(history: DataFrame, entry: DataFrame, keep: int) -> DataFrame:
    """History with new entries, newest first, cut to `keep` rows."""
    return history.unionByName(entry).orderBy(F.desc("completed_at"), F.desc("session_id")).limit(keep)


def scores_to_map_rows(sessions: DataFrame) -> DataFrame:
    """(session_id, image_id, record fields) from a map of records per session."""
    return sessions.select("session_id", F.explode("scores").alias("image_id", "record")).select(
        "session_id", "image_id", "record.*"
    )
