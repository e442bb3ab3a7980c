"""Orders, samples, pages and recent lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions.text import tier_order
from keepsift.operators.ranking import newest_n, running


def basename_key(name: str = "filename") -> Column:
    """Locale-like order of a name: letters before case, punctuation before letters."""
    return F.expr(f"{name} COLLATE UNICODE")


def order_by_basename(files: DataFrame) -> DataFrame:
    return files.orderBy(basename_key(), "path")


def order_by_tier_score(scores: DataFrame) -> DataFrame:
    return scores.orderBy(tier_order(F.col("tier")), F.desc("total"), "image_id")


def order_by_total(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("total"), "image_id")


def recent_list(uses: DataFrame, kind: str = "kind", value: str = "value", ts: str = "ts", n: int = K.RECENT_LIMIT) -> DataFrame:
    """Most recently used distinct values per kind."""
    last = uses.groupBy(kind, value).agg(F.max(ts).alias("last_used"))
    return newest_n(last, n, [F.desc("last_used"), F.asc(value)], [kind])


def latest_sessions(history: DataFrame, n: int = K.HISTORY_KEEP_ON_MAINTENANCE, by: Sequence[str] = ()) -> DataFrame:
    return newest_n(history, n, [F.desc("completed_at"), F.desc("session_id")], by)


def trimmed_sessions(history: DataFrame, n: int = K.HISTORY_KEEP_ON_MAINTENANCE, by: Sequence[str] = ()) -> DataFrame:
    """How many entries a trim to n removes."""
    return history.groupBy(*by).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("removed"))


def profiles_newest(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("created_at"), "id")


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 contained, NULL otherwise; a blank query matches all."""
    q = query.lower().strip()
    if not q:
        return F.lit(0)
    low = F.lower(name)
    return F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2)


def rank_by_match(names: DataFrame, query: str, name: str = "model") -> DataFrame:
    ranked = names.withColumn("match_rank", match_rank(F.col(name), query))
    return ranked.where("match_rank IS NOT NULL").orderBy("match_rank", name)


def preferred_first(names: DataFrame, prefixes: Sequence[str] = K.LOCAL_VISION_PREFIXES, name: str = "model") -> DataFrame:
    from keepsift.operators.filters import has_prefix

    return names.withColumn("preferred", has_prefix(F.col(name), prefixes)).orderBy(F.desc("preferred"), name)


def sample_size(n: Column) -> Column:
    return F.least(F.lit(K.SAMPLE_MAX), F.greatest(F.lit(K.SAMPLE_MIN), F.ceil(n * F.lit(K.SAMPLE_SHARE))))


def evenly_spaced_sample(
    assets: DataFrame, order: Sequence[Column], by: Sequence[str] = (), narrow: Sequence[str] = (), **options
) -> DataFrame:
    """5 to 8 rows at even distances, first and last included; all rows when there are fewer.

    `narrow` names the columns that `order` uses, a unique id first: then only these are numbered, and the few rows
    that are sampled look up the rest.

    Adds `sample_no` from 0. Only the sampled row numbers meet the rows: a row tests itself
    against the (at most 8) positions of its group.
    """
    some = assets.select(*dict.fromkeys([*narrow, *by])) if narrow else assets
    numbered = running(some, order, by, number="_no", **options)
    sizes = numbered.groupBy(*by).agg(F.max("_no").alias("_n"))
    k = sample_size(F.col("_n"))
    places = sizes.select(
        *by,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(k, F.col("_n")) - 1)).alias("sample_no"),
        "_n",
        k.alias("_k"),
    ).select(
        *by,
        "sample_no",
        F.when(F.col("_k") >= F.col("_n"), F.col("sample_no"))
        .otherwise(F.floor(F.col("sample_no") * (F.col("_n") - 1) / (F.col("_k") - 1)))
        .alias("_at"),
    )
    places = places.withColumn("_no", F.col("_at") + 1).drop("_at")
    if not by:
        places = F.broadcast(places)  # at most 8 rows
    sampled = numbered.join(places, [*by, "_no"])
    if not narrow:
        return sampled.select(*assets.columns, "sample_no")
    few = sampled.select(narrow[0], "sample_no")
    return assets.join(few if by else F.broadcast(few), narrow[0]).select(*assets.columns, "sample_no")


def page_of(rows: DataFrame, order: Sequence[Column], columns: int, **options) -> DataFrame:
    """Grid row and column of every row for a column count."""
    i = F.col("_no") - 1
    return running(rows, order, number="_no", **options).select(
        *rows.columns,
        i.alias("position"),
        F.floor(i / columns).alias("grid_row"),
        F.pmod(i, F.lit(columns)).cast("bigint").alias("grid_col"),
    )


def blocks_of(rows: DataFrame, order: Sequence[Column], size: int = K.TAG_BLOCK, **options) -> DataFrame:
    """Number consecutive blocks of `size` rows."""
    return running(rows, order, number="_no", **options).select(
        *rows.columns, F.floor((F.col("_no") - 1) / size).alias("block_no")
    )


def running_totals(results: DataFrame, order: Sequence[Column], by: Sequence[str], total: str, **options) -> DataFrame:
    """Scored count, token sums and seconds left after each result.

    `elapsed_s` is the time since the start of the run, `total` the number of assets.
    """
    from keepsift.functions.numbers import eta_seconds

    sums = {"tokens_in_so_far": F.coalesce("tokens_in", F.lit(0)), "tokens_out_so_far": F.coalesce("tokens_out", F.lit(0))}
    out = running(results, order, by, sums=sums, number="scored_count", **options)
    return out.withColumn("eta_seconds", eta_seconds(F.col("elapsed_s"), F.col("scored_count"), F.col(total)))


def selection_check(files: DataFrame, requested: int, by: Sequence[str] = ()) -> DataFrame:
    """Requested against available; 0 asks for no particular number."""
    n = F.count(F.lit(1))
    return files.groupBy(*by).agg(
        F.lit(requested).cast("bigint").alias("requested"),
        n.alias("available"),
        (F.lit(requested > 0) & (n < requested)).alias("fewer_than_requested"),
    )
