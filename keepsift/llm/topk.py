"""Exact top-k search by inner product: global score histograms locate every k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keepsift.llm.common import integral
from keepsift.session import store

SCALE = 256
#: Rows in a block of candidates, of queries, and queries that are multiplied at once: bounds a task's memory.
CANDIDATES, QUERIES, AT_ONCE = 8192, 4096, 256
#: A round tells apart this many ranges of scores for each query.
BITS = 8


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int, k: int) -> DataFrame:
    """(vec_id, dim, q): components as little-endian 64-bit integers, floor(scale * x); unusable vectors are left out.

    Of equal rows k stay: the k best cannot hold more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, data = [], [], []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    data.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dim", "q"])

    usable = df.select(integral(df, id_col).alias("vec_id"), df[vector_col].alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = usable.mapInArrow(run, "vec_id long, dim int, q binary")
    copies = F.sequence(F.lit(1), F.least(F.count(F.lit(1)), F.lit(k)))
    return rows.groupBy("vec_id", "dim", "q").agg(copies.alias("copies")).withColumn("mark", F.explode("copies")).select("vec_id", "dim", "q")


def _blocks(rows: DataFrame, count: int, most: int, extra: list[str]) -> DataFrame:
    """Rows packed into (block, dim, ids, q, *extra): binary columns of at most `most` rows, ordered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def packed():
            ids = np.array([r[0] for r in held], "<i8").tobytes()
            more = [pa.array([np.array([r[2 + i] for r in held], "<i8").tobytes()], pa.binary()) for i in range(len(extra))]
            fixed = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids], pa.binary()), pa.array([b"".join(r[1] for r in held)], pa.binary())]
            return pa.RecordBatch.from_arrays([*fixed, *more], ["block", "dim", "ids", "q", *extra])

        for b in batches:
            for block, dim, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (key != (block, dim) or len(held) >= most):
                    yield packed()
                    held = []
                key = (block, dim)
                held.append(row)
        if held:
            yield packed()

    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(count))).select("block", "dim", "vec_id", "q", *extra)
    dealt = placed.repartition("block").sortWithinPartitions("block", "dim", "vec_id")
    return dealt.mapInArrow(run, "block long, dim int, ids binary, q binary" + "".join(f", {c} binary" for c in extra))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum is below 2^53, else in whole numbers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


def _over_pairs(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, each, names: list[str]) -> DataFrame:
    """Apply `each(ids, lo, need, own ids, scores)` to every block of queries against every block of candidates.

    Both sides are dealt by (query block, candidate block), so the work spreads over all pairs of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qi, qq, lo, need, ci, cq in zip(*[c.to_pylist() for c in b.columns], strict=True):
                qi, lo, need, ci = (np.frombuffer(x, "<i8") for x in (qi, lo, need, ci))
                q, c = np.frombuffer(qq, "<i8").reshape(-1, dim or 1)[:, :dim], np.frombuffer(cq, "<i8").reshape(-1, dim or 1)[:, :dim]
                if dim == 0:
                    q, c = np.zeros((len(qi), 0), np.int64), np.zeros((len(ci), 0), np.int64)
                for s in range(0, len(qi), AT_ONCE):
                    part = slice(s, s + AT_ONCE)
                    got = each(qi[part], lo[part], need[part], ci, _scores(q[part], c))
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names)

    left = queries.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)).cast("array<bigint>")))
    right = candidates.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)).cast("array<bigint>")))
    right = right.select(F.col("block").alias("other"), F.col("other").alias("block"), "dim", F.col("ids").alias("cids"), F.col("q").alias("cq"))
    met = left.join(right.hint("shuffle_hash"), ["block", "other", "dim"])
    return met.select("dim", "ids", "q", "lo", "need", "cids", "cq").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row whose id is divisible by `every`.

    Each round scores all queries against all rows in blocks and counts the scores per range; summing the counts
    shows the range with a query's k-th score, which the next round divides further, until a range is one value.
    The last pass takes what lies above that value and the smallest ids at it. Tasks report the ranges from the
    top down to their own k-th score only: lower ones cannot hold the global k-th.

    Defined cases: vectors that are NULL or hold NULL or non-finite components, and rows with NULL ids, take no part.
    Every row is a candidate, also where rows repeat an id, except for queries with that id; of rows that repeat a
    query's id the one with the largest components asks. Vectors meet vectors of their own length.
    Queries with fewer than k candidates get all; empty tables give no rows; other columns are ignored.
    """
    rows = store(quantised(df, id_col, vector_col, scale, k), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.max_by("dim", F.struct("dim", "q")).alias("dim"), F.max_by("q", F.struct("dim", "q")).alias("q")
    )

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [int(max(map(abs, np.frombuffer(x, "<i8").tolist()), default=0)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(m) for m in most], pa.float64())], ["most"])

    stats = rows.agg(F.count(F.lit(1)), F.max("dim"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    n, dim, n_queries = stats[0], stats[1] or 0, stats[2]
    most = rows.select("q").mapInArrow(reach, "most double").agg(F.max("most")).first()[0] or 0.0
    bound = min(int(most) ** 2 * dim, 2**62 - 1)
    bits = -(-(2 * bound + 1).bit_length() // BITS) * BITS

    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    candidates = store(_blocks(rows, c_blocks, CANDIDATES, []), "candidate-blocks")
    state = asking.select("vec_id", "dim", "q", F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))

    for shift in range(bits - BITS, -1, -BITS):
        wide = 1 << BITS

        def counted(qi, lo, need, ci, scores, shift=shift, wide=wide):
            at = scores - lo[:, None]
            inside = (at >= 0) & (qi[:, None] != ci[None, :])
            if shift + BITS < 63:
                inside &= at < (1 << (shift + BITS))
            r, c = np.nonzero(inside)
            hist = np.bincount(r * wide + (at[r, c] >> shift), minlength=len(qi) * wide).reshape(len(qi), wide)
            above = hist[:, ::-1].cumsum(1)[:, ::-1] - hist
            r, bucket = np.nonzero((hist > 0) & (above < need[:, None]))
            return qi[r], bucket, hist[r, bucket]

        queries = _blocks(state, q_blocks, QUERIES, ["lo", "need"])
        found = _over_pairs(queries, candidates, q_blocks, c_blocks, counted, ["vec_id", "bucket", "n"])
        sums = found.groupBy("vec_id", "bucket").agg(F.sum("n").alias("n"))
        # At most 2^BITS rows a query.
        down = F.sum("n").over(W.partitionBy("vec_id").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0))
        sums = sums.withColumn("upto", down).join(state.select("vec_id", "need"), "vec_id")
        cut = sums.groupBy("vec_id").agg(
            F.max(F.when(F.col("upto") >= F.col("need"), F.col("bucket"))).alias("bucket"),
            F.max(F.when(F.col("upto") < F.col("need"), F.col("upto"))).alias("passed"),
            F.max(F.when(F.col("bucket") == 0, F.col("n"))).alias("lowest"),
        )
        # A query with too few candidates goes on in the lowest range.
        passed = F.coalesce("passed", F.lit(0)) - F.when(F.col("bucket").isNull(), F.coalesce("lowest", F.lit(0))).otherwise(0)
        state = store(
            state.join(cut, "vec_id", "left").select(
                "vec_id",
                "dim",
                "q",
                (F.col("lo") + F.coalesce("bucket", F.lit(0)) * (1 << shift)).alias("lo"),
                (F.col("need") - passed).alias("need"),
            ),
            "kth",
        )

    def taken(qi, lo, need, ci, scores):
        own = qi[:, None] == ci[None, :]
        tie = (scores == lo[:, None]) & ~own
        tie &= tie.cumsum(1) <= need[:, None]  # candidates are ordered by id
        r, c = np.nonzero(((scores > lo[:, None]) & ~own) | tie)
        return qi[r], ci[c], scores[r, c]

    best = _over_pairs(_blocks(state, q_blocks, QUERIES, ["lo", "need"]), candidates, q_blocks, c_blocks, taken, ["query_id", "vec_id", "score"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
