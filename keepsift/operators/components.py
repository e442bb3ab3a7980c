"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.session import store


#: Distinct edges that one task joins; more go through rounds over all tasks.
FEW_EDGES = 100_000


#: Nodes that a task keeps while it folds its edges.
FOLD_NODES = 500_000


def _union(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one task -> (node, root) by union-find. Beyond `most` nodes it starts anew; what it gives then
    joins the same nodes as the edges did."""
    above: dict = {}
    kind = None

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def found() -> pa.RecordBatch:
        nodes = list(above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["node", "root"])

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((top(u), top(v)))
            above[high] = low
        if most and len(above) > most:
            yield found()
            above.clear()
    if above:
        yield found()


def _folded(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes: each task keeps a tree per component of its share, so a dense graph shrinks to
    about its nodes before anything is shuffled."""
    kind = edges.schema["u"].dataType.simpleString()
    trees = edges.mapInArrow(lambda batches: _union(batches, FOLD_NODES), f"node {kind}, root {kind}")
    return trees.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    Every task first folds its edges into trees. Up to `few` edges, once repeated ones are gone, are joined in one task; more go through rounds.

    Each round hangs neighbours on their smallest neighbour (Kiveris et al. 2014), which needs
    about log n rounds on long chains too. A round is written to the shared folder before the
    next starts. Minima combine on the map side; a hub only meets one row of minima in the join,
    and the skewed join side is split by AQE.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    now = store(_folded(ends).distinct(), "edges")
    mark = _fingerprint(now)
    if mark[0] <= few:
        kind = now.schema["u"].dataType.simpleString()
        return store(now.coalesce(1).mapInArrow(_union, f"node {kind}, root {kind}"), "components")
    while True:
        now = store(_small_star(_large_star(now)), "stars")
        seen, mark = mark, _fingerprint(now)
        if seen == mark:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return pairs.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: count and two order-free sums."""
    mod = F.lit(2**31 - 1)
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.pmod(F.xxhash64("u", "v"), mod)),
            F.sum(F.pmod(F.xxhash64("v", "u"), mod)),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
