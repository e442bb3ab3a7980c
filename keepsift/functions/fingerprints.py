"""64-bit fingerprints as BIGINT and their distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.session import spread


def from_hex(text: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(text, 16, -10).cast("bigint")


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits that differ between the first 64 digits of two hex texts.

    The shorter text is padded with zero bytes on the right; a last single digit is a byte of its own.
    """

    def padded(text: Column) -> Column:
        t = F.substring(text, 1, 64)
        n = F.length(t)
        whole = F.concat(F.substring(t, F.lit(1), n - 1), F.lit("0"), F.substring(t, n, F.lit(1)))
        return F.rpad(F.when(n % 2 == 1, whole).otherwise(t), 64, "0")

    pad_a, pad_b = padded(a), padded(b)
    dist = F.lit(0)
    for start in range(1, 64, 16):
        dist = dist + hamming(
            from_hex(F.substring(pad_a, start, 16)), from_hex(F.substring(pad_b, start, 16))
        )
    return dist


def sign_bits(vector: Column, dims: int = 64) -> Column:
    """Bit i is set where component i is above 0."""
    out = F.lit(0).cast("bigint")
    for i in range(dims):
        bit = F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint")
        )
        out = out.bitwiseOR(bit)
    return F.when(vector.isNotNull(), out)


def word_hash(word: Column) -> Column:
    return from_hex(F.substring(F.md5(word), 1, 16))


def simhash(df: DataFrame, id_col: str, text_col: str, out: str = "fp") -> DataFrame:
    """(id, fp): SimHash of the case-folded words of the whole text.

    All words of a text leave one row, so the sums collapse on the map side and only one row of
    counters per text is shuffled. A counter holds bit i in its lower and bit i + 32 in its upper
    half. A text without words gets a NULL fingerprint.
    """
    words = spread(df.select(id_col, text_col), id_col).select(
        id_col, F.explode_outer(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+")).alias("w")
    )
    hashed = words.select(id_col, F.when(F.col("w") != "", word_hash(F.col("w"))).alias("h"))
    halves = F.lit((1 << 32) + 1)
    ones = hashed.groupBy(id_col).agg(
        F.count("h").alias("n"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(halves)).alias(f"c{i}") for i in range(32)],
    )
    bits = F.lit(0).cast("bigint")
    for i in range(64):
        c = F.col(f"c{i % 32}")
        n_set = c.bitwiseAND(F.lit((1 << 32) - 1)) if i < 32 else F.shiftrightunsigned(c, 32)
        bit = F.when(n_set * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
        bits = bits.bitwiseOR(bit)
    return ones.select(id_col, F.when(F.col("n") > 0, bits).alias(out))
