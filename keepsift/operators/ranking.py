"""Exact ranks, running values and top-n cuts that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsift.session import store

# Largest group a single task may sort; larger ones are split by range.
SPLIT_ROWS = 1_000_000
# ... and the texts and binaries it may carry along.
SPLIT_BYTES = 512 << 20


def running(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    number: str | None = "row_no",
    split_rows: int = SPLIT_ROWS,
    parts: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Add row number (from 1), running sums and running maxima, current row included.

    `order` must be a total order within a group. While every group of `by` (or, without `by`,
    the whole input) fits `split_rows` this is one window; a count checks that first. Otherwise
    rows are range-partitioned on (by, order), so a hot group spreads over many tasks; each piece
    gets its local values and the carry from the pieces before it. At most one group runs across
    a partition border, so the carries number no more than the partitions and are safe to
    broadcast. `parts` forces that many pieces; `fits=True` says that the sizes are known to fit.
    """
    by, sums, maxima = list(by), dict(sums or {}), dict(maxima or {})
    if fits or (not parts and groups_fit(df, by, split_rows)):
        return _local(df, by, order, sums, maxima, number)

    keys = [F.col(c) for c in by] + list(order)
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys)
    # The partition id is stored: a retried or repeated range sampling must not move rows.
    kept = store(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    group = ["_part", *by]
    local = _local(kept, group, order, sums, maxima, "_no")
    pieces = kept.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_c_no"),
        *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_c_{n}") for n, c in maxima.items()],
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select(
        *group,
        F.sum("_c_no").over(before).alias("_c_no"),
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    ).where(F.col("_c_no") > 0)
    out = local.join(F.broadcast(carry), group, "left")
    new = {number or "_no": (F.col("_no") + F.coalesce("_c_no", F.lit(0))).cast("bigint")}
    new.update({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums})
    new.update({n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxima})
    if not number:
        new.pop("_no")
    return out.withColumns(new).select(*df.columns, *new)


def groups_fit(df: DataFrame, by: Sequence[str], split_rows: int = SPLIT_ROWS) -> bool:
    """Whether no group of `by` (or the input, without `by`) has more than `split_rows` rows or, in its texts and
    binaries, `SPLIT_BYTES`."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum(wide[1:], wide[0]).cast("bigint") if wide else F.lit(0).cast("bigint")
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).agg(F.max("rows"), F.max("bytes")).first()
    return (most[0] or 0) <= split_rows and (most[1] or 0) <= SPLIT_BYTES


def _local(df, group, order, sums, maxima, number) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {n: F.sum(c).over(upto) for n, c in sums.items()}
    new.update({n: F.max(c).over(upto) for n, c in maxima.items()})
    if number:
        new[number] = F.row_number().over(w).cast("bigint")
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def top_cuts(
    df: DataFrame,
    takes: Mapping[str, Column],
    score: str = "total",
    tie: str = "image_id",
    by: Sequence[str] = (),
    extra: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Where the first `take` rows by (score desc, tie asc) end, per group and label.

    `takes` gives each label a row count as an expression over `n`, the group size, and the
    columns of `extra` (one row per group, or a single row). The result has one row per group
    with a struct (score, tie) per label: NULL selects nothing, a NULL tie takes all rows of the
    score. Use it with `with_cuts` and `is_within`.

    Rows are only counted: per score, and, where a cut falls between equal scores, those rows
    again by prefix of the tie. The rows themselves are not shuffled; only those with the score
    and the prefix of a cut are, a small part where ids are spread evenly, as SHA-256 ids are.
    """
    by = list(by)
    counted = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    hist = store(counted, "counts")
    if by:
        sizes = hist.groupBy(*by).agg(F.sum("_c").alias("n"))
        sizes = sizes.join(extra, by, "left") if extra is not None else sizes
    else:
        scores, n = hist.agg(F.count(F.lit(1)), F.coalesce(F.sum("_c"), F.lit(0))).first()
        options = {"fits": scores <= SPLIT_ROWS, **options}
    upto = running(hist, [F.desc("_s")], by, sums={"_upto": F.col("_c")}, number=None, **options)
    if by:
        hist = upto.join(sizes, by)
    else:
        hist = upto.withColumn("n", F.lit(n).cast("bigint"))
        hist = _literals(hist, extra) if extra is not None else hist
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("label"), c.cast("bigint").alias("take")) for k, c in takes.items()])
    )
    cuts = (
        hist.select("*", wanted.alias("_t"))
        .withColumn("_need", F.least("_t.take", "n") - (F.col("_upto") - F.col("_c")))
        .where((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
        .select(*by, F.col("_t.label").alias("label"), "_s", "_need", (F.col("_need") == F.col("_c")).alias("_all"))
    )
    # One row per group and label, stored so that the joins below know how small it is.
    cuts = store(cuts, "cuts")
    split = cuts.where(~F.col("_all")).drop("_all")
    if split.isEmpty():
        exact = cuts.select(*by, "label", F.lit(None).cast("string").alias("_tie")).limit(0)
    else:
        exact = _tie_cuts(df, split, score, tie, by)
    full = cuts.join(exact, [*by, "label"], "left")
    one = full.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("label") == k, F.struct(F.col("_s").alias("score"), F.col("_tie").alias("tie")))).alias(
                k
            )
            for k in takes
        ]
    )
    return store(one, "cuts") if by else one


def _tie_cuts(df: DataFrame, split: DataFrame, score: str, tie: str, by: Sequence[str]) -> DataFrame:
    """(by, label, _tie): the `_need`-th smallest tie among the rows with the score of a cut."""
    ties = df.select(*by, F.col(score).alias("_s"), F.col(tie).cast("string").alias("_tie")).join(split, [*by, "_s"])
    ties = ties.withColumn("_pre", F.substring("_tie", 1, 4))
    up = Window.partitionBy(*by, "label").orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    place = (
        ties.groupBy(*by, "label", "_pre", "_need")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_rest", F.col("_need") - F.coalesce(F.sum("_c").over(up), F.lit(0)))
        .where((F.col("_rest") > 0) & (F.col("_rest") <= F.col("_c")))
        .select(*by, "label", "_pre", "_rest", "_c")
    )
    # One row per cut. Its count tells whether one task may sort the rows of a prefix; ids that
    # are not spread over their first characters can make it large.
    place = store(place, "prefixes")
    fits = (place.agg(F.max("_c")).first()[0] or 0) <= SPLIT_ROWS
    inner = ties.drop("_need").join(place.drop("_c"), [*by, "label", "_pre"])
    numbered = running(inner, [F.col("_tie")], [*by, "label", "_pre"], number="_rn", split_rows=SPLIT_ROWS, fits=fits or None)
    return numbered.where(F.col("_rn") == F.col("_rest")).select(*by, "label", "_tie")


def _literals(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a single row as constants; no join."""
    row = one_row.first()
    new = {}
    for f in one_row.schema.fields:
        value = row[f.name] if row is not None else None
        if value is not None and hasattr(value, "asDict"):
            parts = [F.lit(value[g.name]).cast(g.dataType).alias(g.name) for g in f.dataType.fields]
            new[f.name] = F.struct(*parts)
        else:
            new[f.name] = F.lit(value).cast(f.dataType)
    return df.withColumns(new)


def is_within(cut: Column, score: str = "total", tie: str = "image_id") -> Column:
    s = F.col(score)
    tied = (s == cut["score"]) & (cut["tie"].isNull() | (F.col(tie).cast("string") <= cut["tie"]))
    return F.coalesce((s > cut["score"]) | tied, F.lit(False))


def with_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the cuts of its group to each row; without groups they are constants."""
    return df.join(cuts, list(by), "left") if by else _literals(df, cuts)


def top_rows(df, take: Column, score="total", tie="image_id", by=(), extra=None) -> DataFrame:
    """The first `take` rows per group by (score desc, tie asc)."""
    cuts = top_cuts(df, {"_cut": take}, score, tie, by, extra)
    return with_cuts(df, cuts, by).where(is_within(F.col("_cut"), score, tie)).select(*df.columns)


def latest(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the greatest (newest...) per key. Combines on the map side, so a key with
    many versions sends one row per task."""
    cols = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*cols), F.struct(*newest)) if cols else F.lit(None)
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*df.columns)


def newest_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First n rows per group. Spark cuts each task's rows to n per group before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
