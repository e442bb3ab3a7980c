"""Monthly quota with clock check, as a batch over a whole usage log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.operators.ranking import SPLIT_ROWS, groups_fit, running
from keepsift.session import store

UNLIMITED = 2**53 - 1
TOLERANCE_US = K.CLOCK_TOLERANCE_SECONDS * 1_000_000


def quota_fold(events: DataFrame, **options) -> DataFrame:
    """Outcome of every usage event: success, remaining, error (NULL, QUOTA_EXCEEDED, CLOCK_TAMPER).

    events(user_id, seq, ts_us, month_key, n >= 1, quota): in order of seq, an event of another
    month than the user's record starts a fresh record; an event more than an hour before the
    last accepted one is refused; one that would exceed the quota is refused. Refused events
    leave the record alone. A NULL quota is unlimited.

    The fold is sequential only where it must be:
    - An event with n within the quota always leaves the record on its own month, so runs of
      equal months are independent of each other.
    - Within a run, an event no earlier than an hour before the latest time so far can never be
      refused by the clock. Of those with equal n, only the first quota // n can be accepted.
    The few remaining candidates are folded in order, row by row without gathering them; the
    outcome of all other events follows from running values.
    """
    free = events.where(F.col("quota").isNull()).select(
        *events.columns,
        F.lit(True).alias("success"),
        F.lit(UNLIMITED).cast("bigint").alias("remaining"),
        F.lit(None).cast("string").alias("error"),
    )
    limited = store(events.where(F.col("quota").isNotNull()).withColumn("_small", F.col("n") <= F.col("quota")), "usage")
    if "parts" not in options and groups_fit(limited, ["user_id"], options.get("split_rows", SPLIT_ROWS)):
        options = {**options, "fits": True}  # so do all groups within a user

    # Month of the small event before: number the small events and look one number back.
    small = running(limited.where("_small"), [F.col("seq")], ["user_id"], number="_no", **options)
    back = small.select("user_id", (F.col("_no") + 1).alias("_no"), F.col("month_key").alias("_prev"))
    starts = small.join(back, ["user_id", "_no"], "left").select(
        "user_id", "seq", (~F.col("_prev").eqNullSafe(F.col("month_key"))).cast("int").alias("_start")
    )
    flagged = limited.join(starts, ["user_id", "seq"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    # Run number, and the month its first event set (first by seq, so the newest start wins).
    # Stored, as the steps below read it several times.
    seg = running(
        flagged,
        [F.col("seq")],
        ["user_id"],
        sums={"_run": F.col("_start")},
        maxima={"_open": F.when(F.col("_start") == 1, F.struct("seq", "month_key"))},
        number=None,
        **options,
    ).withColumn("_same", F.coalesce(F.col("_open.month_key") == F.col("month_key"), F.lit(False)))
    seg = store(seg.drop("_open", "_start"), "runs")

    inside = running(
        seg.where("_small"), [F.col("seq")], ["user_id", "_run"], maxima={"_high": F.col("ts_us")}, number=None, **options
    )
    clean = F.col("ts_us") >= F.col("_high") - TOLERANCE_US
    cand_cols = ["user_id", "_run", "seq", "ts_us", "n", "quota"]
    first = (
        running(inside.where(clean), [F.col("seq")], ["user_id", "_run", "n"], number="_k", **options)
        .where(F.col("_k") * F.col("n") <= F.col("quota"))
        .select(*cand_cols)
    )
    candidates = first.unionByName(inside.where(~clean).select(*cand_cols))
    accepted = (
        candidates.repartition("user_id", "_run")
        .sortWithinPartitions("user_id", "_run", "seq")
        .mapInPandas(_accept, "user_id bigint, seq bigint, _acc int")
    )

    joined = seg.join(accepted, ["user_id", "seq"], "left").withColumn("_acc", F.coalesce("_acc", F.lit(0)))
    state = running(
        joined,
        [F.col("seq")],
        ["user_id", "_run"],
        sums={"_count": F.col("_acc") * F.col("n")},
        maxima={"_last": F.when(F.col("_acc") == 1, F.struct("seq", "ts_us"))},
        number=None,
        **options,
    )
    count = F.when(F.col("_same"), F.col("_count")).otherwise(F.lit(0))
    tampered = F.coalesce(F.col("_same") & (F.col("ts_us") < F.col("_last.ts_us") - TOLERANCE_US), F.lit(False))
    ok = F.col("_acc") == 1
    error = F.when(ok, F.lit(None)).when(tampered, "CLOCK_TAMPER").otherwise("QUOTA_EXCEEDED")
    remaining = F.when(~ok & tampered, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("quota") - count))
    return state.select(
        *events.columns, ok.alias("success"), remaining.cast("bigint").alias("remaining"), error.alias("error")
    ).unionByName(free)


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark accepted candidates; rows come sorted by user, run, seq and only the record is kept."""
    key, used, last = None, 0, None
    for pdf in batches:
        out = []
        for row in zip(pdf["user_id"], pdf["_run"], pdf["seq"], pdf["ts_us"], pdf["n"], pdf["quota"]):
            user, run, seq, ts, n, quota = row
            if (user, run) != key:
                key, used, last = (user, run), 0, None
            if (last is not None and ts < last - TOLERANCE_US) or used + n > quota:
                continue
            used, last = used + n, ts
            out.append((user, seq, 1))
        yield pd.DataFrame(out, columns=["user_id", "seq", "_acc"])
