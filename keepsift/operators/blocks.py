"""Exact Hamming comparisons by pairs of blocks, for thresholds, sizes and crowded slices at which probing does not pay."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, on average. A pair of blocks is one group, so this bounds what a task holds at once.
BLOCK_ROWS = 16_384
#: Comparisons at once, so that they stay in a core's cache, and pairs that are given on at once.
TILE, PAIRS_AT_ONCE = 262_144, 500_000
#: Comparisons that a task should make.
TASK_WORK = 200_000_000
#: Costs in comparisons: to shuffle and sort a row, and to compare a pair that met under a probe (its conditions are longer).
ROW_COST, PROBE_PAIR_COST = 200, 4
#: Most probes of a row, which are literals of the plan.
MOST_PROBES = 2_000
#: Nodes whose neighbours are looked for at once.
STRIP = 64
#: Blocks of a scope from which on they grow, up to so many times their rows, as every row travels once for each block.
MANY_BLOCKS, GROWTH = 32, 16
#: Rows that meet at once, a strip and a stretch, so that their comparisons stay in a core's cache, and rows that are passed over together.
STRIP_ROWS, STRETCH, CELL = 64, 1024, 32
#: Centres, and rows that they are found from.
CENTRES, CENTRE_ROWS = 4, 2_048


def probe_radii(threshold: int, bands: int) -> list[int]:
    """Radius of every slice: with radii that add up to threshold - bands + 1 one slice must be within its own."""
    budget = threshold - bands + 1
    if budget < 0:
        return [0] * (threshold + 1)
    base, extra = divmod(budget, bands)
    return [base + (i < extra) for i in range(bands)]


def probe_cost(rows: int, squares: int, threshold: int, bands: int, crowding: Sequence[int] = ()) -> tuple[float, int]:
    """(cost, probes of a row) of multi-index probing; `squares` is the sum of rows^2 over scopes. `crowding` has the sum
    of rows^2 over the values of each slice, as `slice_crowding` counts it; without it slices count as evenly spread."""
    width = 64 // bands
    total = meets = 0.0
    for at, radius in enumerate(probe_radii(threshold, bands)):
        left, right = (sum(math.comb(width, k) for k in range(r + 1)) for r in ((radius + 1) // 2, radius // 2))
        total += left + right
        meets += left * right * (crowding[at] if crowding else squares / 2**width)
    return ROW_COST * rows * total + PROBE_PAIR_COST * meets, int(total)


def block_cost(rows: int, squares: int) -> float:
    """Every pair of a scope once, every row once for each block of its scope."""
    return squares / 2 + ROW_COST * (rows + squares / BLOCK_ROWS)


def choose_bands(rows: int, squares: int, threshold: int, crowding: Mapping[int, Sequence[int]] | None = None) -> int:
    """Number of slices to probe with; 0 where comparing blocks is cheaper."""
    best, least = 0, block_cost(rows, squares)
    for bands in range(3, 9):
        cost, probes = probe_cost(rows, squares, threshold, bands, crowding[bands] if crowding else ())
        if probes <= MOST_PROBES and cost < least:
            best, least = bands, cost
    return best


def scope_sizes(nodes: DataFrame, by: Sequence[str]) -> tuple[int, int, int]:
    """(rows, sum of rows^2, largest scope)."""
    n = F.col("count").cast("double")
    got = nodes.groupBy(*by).count().agg(F.sum("count"), F.sum(n * n), F.max("count")).first()
    return tuple(int(x or 0) for x in got)


def slices(bands: int) -> list[tuple[int, int]]:
    """(offset, width) of every slice of the 64 bits."""
    base, extra = divmod(64, bands)
    return [(i * base + min(i, extra), base + (i < extra)) for i in range(bands)]


def slice_crowding(nodes: DataFrame, by: Sequence[str]) -> dict[int, list[int]]:
    """Sum of rows^2 over the values of each slice, by number of slices. Fingerprints of texts share most of their bits,
    so many more rows meet under a value than if they were random."""
    all_ = [(n, i, offset, (1 << width) - 1) for n in range(3, 9) for i, (offset, width) in enumerate(slices(n))]
    parts = F.expr("array(" + ", ".join(f"struct({n}, {i}, {offset}, {ones}L)" for n, i, offset, ones in all_) + ")")
    value = F.expr("shiftrightunsigned(fp, _offset)").bitwiseAND(F.col("_ones")).alias("_value")
    rows = nodes.select(*by, "fp", F.inline(parts).alias("_bands", "_slice", "_offset", "_ones")).select(*by, "_bands", "_slice", value)
    n = F.col("count").cast("double")
    found = rows.groupBy(*by, "_bands", "_slice", "_value").count().groupBy("_bands", "_slice").agg(F.sum(n * n).alias("squares"))
    counted = {(r["_bands"], r["_slice"]): int(r["squares"]) for r in found.collect()}
    return {n: [counted.get((n, i), 0) for i in range(n)] for n in range(3, 9)}


def bands_for(nodes: DataFrame, by: Sequence[str], threshold: int) -> tuple[int, int, int]:
    """(number of slices to probe with or 0, sum of rows^2 over scopes, largest scope). Where probing would pay on evenly
    spread slices, the slices are counted."""
    rows, squares, largest = scope_sizes(nodes, by)
    bands = choose_bands(rows, squares, threshold)
    if bands:
        bands = choose_bands(rows, squares, threshold, slice_crowding(nodes, by))
    return bands, squares, largest


def _pairs_of_blocks(nodes: DataFrame, by: Sequence[str], largest: int, rows: int) -> DataFrame:
    """Each row under (_low, _high) for every pair of blocks of its scope, `_second` where its own block is the second;
    a block with itself has its rows once. Rows without a scope value stay out."""
    if by:
        sizes = nodes.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_blocks"))
        placed = nodes.join(sizes, list(by))
    else:
        placed = nodes.withColumn("_blocks", F.lit(max(1, math.ceil(largest / rows))))
    # Fingerprints are distinct, so a hash spreads them evenly.
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    met = placed.select(*nodes.columns, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return met.select(
        *nodes.columns, F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), (F.col("_own") > F.col("_other")).alias("_second")
    )


def _tasks(squares: int, largest: int, rows: int) -> int:
    """Tasks for the work at hand, not more than the largest scope has pairs of blocks (but for many scopes)."""
    blocks = max(1, math.ceil(largest / rows))
    scopes = max(1, squares // max(1, largest**2))
    return int(max(1, min(math.ceil(squares / 2 / TASK_WORK), scopes * blocks * (blocks + 1) // 2, 100_000)))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        marks = pdf[keys]
        new = (marks != marks.shift()).any(axis=1).to_numpy()
        new[0] = bool(held) and (held[-1][keys].iloc[-1] != marks.iloc[0]).any()
        begun = 0
        for at in np.flatnonzero(new).tolist():
            if held or at > begun:
                yield pd.concat([*held, pdf.iloc[begun:at]], ignore_index=True)
            held, begun = [], at
        held.append(pdf.iloc[begun:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _compare(
    df: DataFrame, by: Sequence[str], tasks: int, each: Callable[[pd.DataFrame], Iterator[dict]], out: str, of: Sequence[str] = ("_low", "_high")
) -> DataFrame:
    """The columns (by, and what `each` gives) for every pair of blocks; a task holds one pair at a time."""
    keys = [*by, *of]
    names = [c.split()[0] for c in out.split(", ")]
    kinds = [(f.name, f.dataType.simpleString()) for f in df.select(*by).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _groups(batches, keys):
            for found in each(pdf):
                n = len(found[names[0]])
                if n:
                    scope = [pa.array([pdf[c].iat[0]] * n, field_types[c]) for c in by]
                    yield pa.RecordBatch.from_arrays([*scope, *[pa.array(found[c]) for c in names]], names=[*by, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    field_types = {f.name: to_arrow_type(f.dataType) for f in df.select(*by).schema}
    schema = ", ".join([*[f"`{n}` {t}" for n, t in kinds], out])
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of the first block, of the second, whether they are the same)."""
    second = pdf["_second"].to_numpy(bool)
    if pdf["_low"].iat[0] == pdf["_high"].iat[0]:
        return np.arange(len(pdf)), np.arange(len(pdf)), True
    return np.flatnonzero(~second), np.flatnonzero(second), False


def _strips(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, part) of `one`, as many as a tile holds."""
    step = max(1, TILE // max(1, len(other)))
    for i in range(0, len(one), step):
        yield i, one[i : i + step]


def block_pairs(nodes: DataFrame, threshold: int, by: Sequence[str], squares: int, largest: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, fp_a, fp_b, distance) of distinct fingerprints, each pair of rows met once."""

    def pairs(pdf: pd.DataFrame) -> Iterator[dict]:
        signed = pdf["fp"].to_numpy(np.int64)
        fps = signed.view(np.uint64)
        one, other, within = _sides(pdf)
        for start, some in _strips(one, other):
            # Within a block only later rows are met.
            rest = other[start:] if within else other
            far = np.bitwise_count(fps[some][:, None] ^ fps[rest][None, :])
            near = far <= threshold
            if within:
                near &= np.arange(len(rest))[None, :] > np.arange(len(some))[:, None]
            i, j = np.nonzero(near)
            for k in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                a, b = signed[some[p]], signed[rest[q]]
                yield {"fp_a": np.minimum(a, b), "fp_b": np.maximum(a, b), "distance": far[p, q].astype(np.int32)}

    met = _pairs_of_blocks(nodes.select(*by, "fp"), by, largest, rows)
    return _compare(met, by, _tasks(squares, largest, rows), pairs, "fp_a bigint, fp_b bigint, distance int")


def grown_rows(largest: int, rows: int) -> int:
    """Rows of a block where the largest scope would have many of `rows` rows."""
    return max(rows, min(GROWTH * rows, math.ceil(largest / MANY_BLOCKS)))


def _compare_arrays(
    nodes: DataFrame, columns: Sequence[str], by: Sequence[str], rows: int, tasks: int, each: Callable[..., dict], out: str
) -> DataFrame:
    """The columns (by, and what `each` gives) for every pair of blocks of which one has the rows that are marked `_asking`.

    A block travels as one array, so a pair of blocks is two rows. `each` gets the columns as arrays of the first block,
    and those of the second one or None for a block with itself. Rows without a scope value stay out.
    """
    by = list(by)
    asking = F.col("_asking")
    sizes = nodes.groupBy(*by).agg(*[F.ceil(F.count_if(x) / rows).cast("int").alias(c) for x, c in ((asking, "_first"), (~asking, "_rest"))])
    placed = nodes.join(sizes, by) if by else nodes.crossJoin(F.broadcast(sizes))
    # Fingerprints are distinct, so a hash spreads them evenly.
    own = F.when(asking, F.pmod(F.xxhash64("fp"), F.greatest("_first", F.lit(1)))).otherwise(
        F.col("_first") + F.pmod(F.xxhash64("fp"), F.greatest("_rest", F.lit(1)))
    )
    placed = placed.where("_first > 0").withColumn("_own", own.cast("int"))
    blocks = placed.groupBy(*by, "_first", "_rest", "_own").agg(F.collect_list(F.struct(*columns)).alias("_held"))
    others = F.expr("sequence(0, IF(_own < _first, _first + _rest, _first) - 1)")
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    met = blocks.withColumn("_other", F.explode(others)).select(
        *by, low.alias("_low"), high.alias("_high"), (F.col("_own") > F.col("_other")).alias("_second"), (F.col("_first") + F.col("_rest")).alias("_all"), "_held"
    )
    # The pairs of a scope are numbered, so that they go to as many tasks.
    pair = F.expr("_low * cast(_all AS bigint) - _low * cast(_low - 1 AS bigint) / 2 + _high - _low").cast("bigint")
    task = F.pmod((F.xxhash64(*by) if by else F.lit(0)) + pair, F.lit(tasks)).cast("int")
    keys = [*by, "_low", "_high"]
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for b in batches:
            marks = zip(*[b.column(k).to_pylist() for k in keys], strict=True)
            held = b.column("_held")
            ends = held.offsets.to_pylist()
            parts = [held.values.field(c).to_numpy(zero_copy_only=False) for c in columns]
            for at, (mark, second) in enumerate(zip(marks, b.column("_second").to_pylist(), strict=True)):
                here = [x[ends[at] : ends[at + 1]] for x in parts]
                if second and (first is None or first[0] != mark):
                    continue  # the first block has no rows
                if not second:
                    first = mark, here
                    if mark[-1] != mark[-2]:
                        continue
                found = each(first[1], here if second else None)
                n = len(found[names[0]])
                if n:
                    scope = [pa.array([x] * n, t) for x, t in zip(mark, kinds, strict=False)]
                    yield pa.RecordBatch.from_arrays([*scope, *[pa.array(found[c]) for c in names]], names=[*by, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    fields = nodes.select(*by).schema.fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], out])
    dealt = met.repartitionById(tasks, task).sortWithinPartitions(*keys, "_second")
    return dealt.select(*keys, "_second", "_held").mapInArrow(run, schema)


def _centres(fps: np.ndarray) -> np.ndarray:
    """Middles of crowds of some of the rows: for each, the bits that most of the rows nearest to it have."""
    some = fps[:: max(1, len(fps) // CENTRE_ROWS)][:CENTRE_ROWS]
    out = some[:1]
    away = np.bitwise_count(some ^ out[0])
    for _ in range(CENTRES - 1):  # far from one another, to begin with
        out = np.append(out, some[int(away.argmax())])
        away = np.minimum(away, np.bitwise_count(some ^ out[-1]))
    places = np.arange(64, dtype=np.uint64)
    bits = (some[:, None] >> places & np.uint64(1)).astype(bool)
    for _ in range(4):
        nearest = np.bitwise_count(some[:, None] ^ out[None, :]).argmin(1)
        for k in range(len(out)):
            if (nearest == k).any():
                out[k] = np.bitwise_or.reduce(np.where(bits[nearest == k].mean(0) > 0.5, np.uint64(1) << places, np.uint64(0)))
    return out


def _placed(fps: np.ndarray, centres: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by centre and distance, smallest and largest distance of each `size` of them to every centre)."""
    away = np.bitwise_count(fps[:, None] ^ centres[None, :])
    nearest = away.argmin(1)
    order = np.lexsort((away.min(1), nearest))
    starts = np.arange(0, len(fps), size)
    ends = (f.reduceat(away[order], starts).astype(np.int16).T for f in (np.minimum, np.maximum))
    return order, *map(np.ascontiguousarray, ends)


def near_tiles(one: np.ndarray, other: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in `one`, in `other`, which of them are within the threshold) for tiles that have all pairs within it.

    Rows whose distances to a centre differ by more than the threshold cannot be within it of each other, so strips of
    rows alike pass over what lies elsewhere. What is given is valid until the next tile.
    """
    if not len(one) or not len(other):
        return
    centres = _centres(other)
    rows, low, high = _placed(one, centres, STRIP_ROWS)
    others, least, most = _placed(other, centres, CELL)
    a, b = one[rows], other[others]
    buffers = [np.empty(STRIP_ROWS * STRETCH, t) for t in (np.uint64, np.uint8, bool)]
    for at, start in enumerate(range(0, len(a), STRIP_ROWS)):
        strip = a[start : start + STRIP_ROWS]
        meet = ((low[:, at, None] - most <= threshold) & (least - high[:, at, None] <= threshold)).all(0)
        picked = np.flatnonzero(np.repeat(meet, CELL)[: len(b)])
        for k in range(0, len(picked), STRETCH):
            stretch = picked[k : k + STRETCH]
            shape = len(strip), len(stretch)
            differ, count, near = (x[: shape[0] * shape[1]].reshape(shape) for x in buffers)
            np.bitwise_xor(strip[:, None], b[stretch][None, :], out=differ)
            np.less_equal(np.bitwise_count(differ, out=count), threshold, out=near)
            yield rows[start : start + STRIP_ROWS], others[stretch], near


def block_links(nodes: DataFrame, threshold: int, by: Sequence[str], squares: int, largest: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, fp, links) for every distinct fingerprint that has others within the threshold: how many. No pair is written."""

    def links(first: list[np.ndarray], second: list[np.ndarray] | None) -> dict:
        (one,), (other,) = first, first if second is None else second
        of_one, of_other = np.zeros(len(one), np.int64), np.zeros(len(other), np.int64)
        for some, met, near in near_tiles(one.view(np.uint64), other.view(np.uint64), threshold):
            # A strip has fewer rows than a byte counts.
            of_other[met] += np.add.reduce(near.view(np.uint8), axis=0, dtype=np.uint8)
            if second is not None:
                # Eight comparisons are one number with as many bits as pairs.
                whole = len(met) % 8 == 0
                of_one[some] += np.bitwise_count(near.view(np.uint64)).sum(1, dtype=np.int64) if whole else near.sum(1)
        if second is None:  # a row meets itself as well
            fps, counts = one, of_other - 1
        else:
            fps, counts = np.concatenate([one, other]), np.concatenate([of_one, of_other])
        return {"fp": fps[counts > 0], "links": counts[counts > 0]}

    rows = grown_rows(largest, rows)
    met = nodes.select(*by, "fp", F.lit(True).alias("_asking"))
    counted = _compare_arrays(met, ["fp"], by, rows, _tasks(squares, largest, rows), links, "fp bigint, links bigint")
    return counted.groupBy(*by, "fp").agg(F.sum("links").alias("links"))


def _meeting(fps: np.ndarray, second: np.ndarray, threshold: int, within: bool) -> np.ndarray:
    """Rows that have another one within the threshold; most have none."""
    out = np.zeros(len(fps), bool)
    one, other = (np.arange(len(fps)),) * 2 if within else (np.flatnonzero(~second), np.flatnonzero(second))
    for _, some in _strips(one, other):
        near = np.bitwise_count(fps[some][:, None] ^ fps[other][None, :]) <= threshold
        # Within a block a row meets itself as well.
        out[some] |= near.sum(1) > int(within)
        if not within:
            out[other] |= near.any(0)
    return out


def forest(fps: np.ndarray, second: np.ndarray, threshold: int, within: bool) -> list[tuple[int, int]]:
    """(root, member) places of a spanning forest of the pairs within `threshold`; a root comes first in its tree.

    Fingerprints meet all others (`within`), or only those of the other side. Each is compared with those not reached
    yet, so a dense group costs little and its pairs are never listed.
    """
    out: list[tuple[int, int]] = []
    waiting = _meeting(fps, second, threshold, within)
    for start in np.flatnonzero(waiting).tolist():
        if not waiting[start]:
            continue
        waiting[start] = False
        front = [start]
        while front:
            strip = np.array(front[:STRIP])
            front = front[STRIP:]
            sides = [(strip, waiting)] if within else [(strip[second[strip] == s], waiting & (second != s)) for s in (False, True)]
            for some, open_ in sides:
                others = np.flatnonzero(open_)
                if len(some) and len(others):
                    near = (np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= threshold).any(0)
                    reached = others[near].tolist()
                    waiting[reached] = False
                    out += [(start, m) for m in reached]
                    front += reached
    return out


def block_forest(
    nodes: DataFrame, threshold: int, by: Sequence[str], squares: int, largest: int, rows: int = BLOCK_ROWS
) -> DataFrame:
    """(by, root, member): edges that join what pairs within the threshold join, at most one per row and pair of blocks.

    Where a scope is one block, its edges lead to the smallest fingerprint (unsigned) of every group.
    """

    def trees(pdf: pd.DataFrame) -> Iterator[dict]:
        signed = pdf["fp"].to_numpy(np.int64)
        fps = signed.view(np.uint64)
        order = np.argsort(fps, kind="stable")
        within = bool(pdf["_low"].iat[0] == pdf["_high"].iat[0])
        edges = forest(fps[order], pdf["_second"].to_numpy(bool)[order], threshold, within)
        places = order[np.array(edges, np.int64).reshape(-1, 2)]
        yield {"root": signed[places[:, 0]], "member": signed[places[:, 1]]}

    met = _pairs_of_blocks(nodes.select(*by, "fp"), by, largest, rows)
    return _compare(met, by, _tasks(squares * 4, largest, rows), trees, "root bigint, member bigint")


def run_forest(rows: DataFrame, threshold: int, by: Sequence[str], keys: Sequence[str], work: int) -> DataFrame:
    """(by, root, member): edges that join what pairs within the threshold among rows(by, fp) of equal keys join; `work`
    is the number of comparisons to expect."""

    def trees(pdf: pd.DataFrame) -> Iterator[dict]:
        signed = pdf["fp"].to_numpy(np.int64)
        edges = forest(signed.view(np.uint64), np.zeros(len(pdf), bool), threshold, True)
        places = np.array(edges, np.int64).reshape(-1, 2)
        yield {"root": signed[places[:, 0]], "member": signed[places[:, 1]]}

    return _compare(rows, by, max(1, math.ceil(4 * work / TASK_WORK)), trees, "root bigint, member bigint", keys)


def joins(one: np.ndarray, groups: np.ndarray, other: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """(group, group) edges, the smaller one first, that join the groups which pairs (one, other) within `threshold` join.
    What is joined already is not looked at again."""
    names, code = np.unique(np.concatenate([groups, others]), return_inverse=True)
    code = code.astype(np.int32)
    above = np.arange(len(names), dtype=np.int32)
    a, b = code[: len(one)], code[len(one) :]

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = int(above[x])
        return x

    out: list[tuple[int, int]] = []
    for some, met, near in near_tiles(one, other, threshold):
        if not near.any():
            continue
        near &= a[some][:, None] != b[met][None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        pairs = np.unique(a[some[i]].astype(np.int64) << 32 | b[met[j]])
        begun = len(out)
        for x, y in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            x, y = sorted((top(x), top(y)))
            if x != y:
                out.append((int(names[x]), int(names[y])))
                above[y] = x
        if len(out) > begun:
            while (above[above] != above).any():
                above = above[above]
            a, b = above[a], above[b]
    return out


def block_joins(nodes: DataFrame, threshold: int, by: Sequence[str], squares: int, largest: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, a, b): edges between the groups of nodes(by, fp, comp) that pairs within the threshold join. With a column
    `_asking`, only pairs that have such a row are looked at; the others have to be of one group."""

    def edges(first: list[np.ndarray], second: list[np.ndarray] | None) -> dict:
        (one, groups), (other, others) = first, first if second is None else second
        found = np.array(joins(one.view(np.uint64), groups, other.view(np.uint64), others, threshold), np.int64).reshape(-1, 2)
        return {"a": found[:, 0], "b": found[:, 1]}

    rows = grown_rows(largest, rows)
    asking = F.col("_asking") if "_asking" in nodes.columns else F.lit(True)
    met = nodes.select(*by, "fp", "comp", asking.alias("_asking"))
    return _compare_arrays(met, ["fp", "comp"], by, rows, _tasks(squares, largest, rows), edges, "a bigint, b bigint").distinct()
