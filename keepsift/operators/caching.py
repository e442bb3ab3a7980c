"""Which cache entries go: by age, then oldest first until the size fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.operators.filters import is_expired
from keepsift.operators.ranking import running


def evict(entries: DataFrame, now: Column, max_age_days: float, max_bytes: int, **options) -> DataFrame:
    """Entries(folder, cache_key, size_bytes, cached_at) with `reason`: age, size or NULL for kept.

    Within a folder the oldest surviving entry goes while what is left exceeds the limit. Bytes
    before an entry are a running sum, so a folder of any size is spread over tasks.
    """
    old = F.coalesce(is_expired(F.col("cached_at"), now, max_age_days), F.lit(False))
    size = F.when(F.col("_old"), F.lit(0)).otherwise(F.col("size_bytes"))
    flagged = entries.withColumn("_old", old)
    summed = running(
        flagged, [F.col("cached_at"), F.col("cache_key")], ["folder"], sums={"_upto": size}, number=None, **options
    )
    totals = flagged.groupBy("folder").agg(F.sum(size).alias("_all"))
    left_before = F.col("_all") - (F.col("_upto") - size)
    reason = F.when(F.col("_old"), "age").when(left_before > max_bytes, "size")
    return summed.join(totals, "folder").select(*entries.columns, reason.alias("reason"))
