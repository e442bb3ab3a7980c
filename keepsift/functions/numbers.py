"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K


def js_round(x: Column, digits: int = 0) -> Column:
    """Round half toward +infinity on the binary double (`round` is decimal, half away from 0)."""
    if digits:
        scale = F.lit(float(10**digits))
        return js_round(x * scale).cast("double") / scale
    low = F.floor(x)
    return F.when(x - low >= 0.5, low + 1).otherwise(low)


def weighted_total(score, weight) -> Column:
    """Sum of score * weight / 100 over the six dimensions, two decimals.

    `score` and `weight` map a dimension name to a column. Terms are added in fixed
    order so that the double result is reproducible.
    """
    raw = F.lit(0.0)
    for d in K.DIMENSIONS:
        raw = raw + score(d) * (weight(d) / F.lit(100.0))
    return js_round(raw, 2)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    million = F.lit(1000000.0)
    raw = (tokens_in / million) * price_in + (tokens_out / million) * price_out
    return js_round(raw, 4)


def price_of(provider: Column, side: int) -> Column:
    """Price per million tokens as an expression; unknown providers cost 0."""
    out = F.lit(0.0)
    for name, prices in K.PROVIDER_PRICES.items():
        out = F.when(provider == name, F.lit(prices[side])).otherwise(out)
    return out


def estimate_cost(provider: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return token_cost(tokens_in, tokens_out, price_of(provider, 0), price_of(provider, 1))


def percent_of(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 when there is nothing to divide by."""
    return F.when(whole > 0, js_round(part / whole * 100.0)).otherwise(F.lit(0)).cast("bigint")


def progress_fraction(scored: Column, total: Column) -> Column:
    return F.when(total > 0, scored / total).otherwise(F.lit(0.0))


def eta_seconds(elapsed: Column, done: Column, total: Column, concurrency: Column | None = None) -> Column:
    """Seconds left, NULL before the first result. Elapsed time is wall-clock; pass
    `concurrency` only to get the optimistic figure that divides by it once more."""
    per_item = elapsed / done
    if concurrency is not None:
        per_item = per_item / concurrency
    return F.when(done > 0, js_round(per_item * (total - done)).cast("bigint"))


def format_eta(seconds: Column) -> Column:
    mins, secs = F.floor(seconds / 60), F.pmod(seconds, F.lit(60))
    return (
        F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit("s remaining")))
        .when(secs == 0, F.concat(F.lit("~"), mins.cast("string"), F.lit(" min remaining")))
        .otherwise(
            F.concat(F.lit("~"), mins.cast("string"), F.lit(" min "), secs.cast("string"), F.lit("s remaining"))
        )
    )


def human_bytes(n: Column) -> Column:
    gib, mib = 1024.0**3, 1024.0**2
    return (
        F.when(n >= gib, F.format_string("%.2f GB", n / gib))
        .when(n >= mib, F.format_string("%.1f MB", n / mib))
        .when(n > 0, F.concat(js_round(n / 1024.0).cast("string"), F.lit(" KB")))
        .otherwise(F.lit("0 B"))
    )


def duration_text(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with two decimals; exact halves go up."""
    whole = js_round(ms).cast("bigint").cast("string")
    s = ms / F.lit(1000.0)
    half = (s * 8 == F.floor(s * 8)) & (F.floor(s * 8) % 2 == 1)
    text = F.call_function("format_number", s + F.when(half, 1e-9).otherwise(0.0), F.lit("0.00"))
    return F.when(ms >= 1000, F.concat(text, F.lit(" s"))).otherwise(F.concat(whole, F.lit(" ms")))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("low")
    )


def fit_dimensions(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Width and height scaled to the longest side, never enlarged."""
    ratio = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return js_round(width * ratio).cast("bigint"), js_round(height * ratio).cast("bigint")


def normalise_weights(df: DataFrame, changed: str, value: str, locked: str) -> DataFrame:
    """Weights (columns named as the dimensions) after one slider moved; they sum to 100 where they can.

    `changed` names the dimension per row, `value` its new weight, `locked` an array of names that
    keep theirs. The rest is shared in proportion among unlocked dimensions; the rounding drift
    goes to the largest of them (the first one on ties). Steps are columns, so that each value is
    computed once.
    """
    dims, zero = K.DIMENSIONS, F.lit(0)

    def total(term):
        return sum((term(d) for d in dims), zero)

    other = {d: F.col(changed) != d for d in dims}
    held = {d: F.array_contains(locked, d) for d in dims}
    step = df.withColumns(
        {
            "_set": F.greatest(zero, F.least(F.lit(100), js_round(F.col(value)))).cast("bigint"),
            "_free": total(lambda d: F.when(other[d] & ~held[d], 1).otherwise(0)),
        }
    ).withColumn("_rest", 100 - F.col("_set"))
    # With every other slider locked, all of them take part.
    step = step.withColumns({f"_in_{d}": other[d] & ((F.col("_free") == 0) | ~held[d]) for d in dims})
    step = step.withColumns(
        {
            "_n": total(lambda d: F.col(f"_in_{d}").cast("int")),
            "_sum": total(lambda d: F.when(F.col(f"_in_{d}"), F.col(d)).otherwise(0)),
        }
    )
    even = (F.col("_sum") == 0) | (F.col("_free") == 0)
    step = step.withColumns(
        {
            f"_raw_{d}": F.when(~F.col(f"_in_{d}"), F.col(d).cast("double"))
            .when(even, F.col("_rest") / F.col("_n"))
            .otherwise(F.col(d) / F.col("_sum") * F.col("_rest"))
            for d in dims
        }
    )
    step = step.withColumns({f"_r_{d}": js_round(F.col(f"_raw_{d}")).cast("bigint") for d in dims})
    ranked = F.array(*[F.when(F.col(f"_in_{d}"), F.col(f"_r_{d}")) for d in dims])
    step = step.withColumns(
        {
            "_drift": F.col("_rest") - total(lambda d: F.when(other[d], F.col(f"_r_{d}")).otherwise(0)),
            "_top": F.array_position(ranked, F.array_max(ranked)),
        }
    )
    done = {
        d: F.when(F.col(changed) == d, F.col("_set"))
        .when(F.col("_top") == i + 1, F.greatest(zero, F.col(f"_r_{d}") + F.col("_drift")))
        .otherwise(F.col(f"_r_{d}"))
        for i, d in enumerate(dims)
    }
    return step.withColumns(done).select(*df.columns)
