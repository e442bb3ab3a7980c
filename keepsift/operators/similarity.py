"""Exact Hamming-distance self-join on 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift import constants as K
from keepsift.functions.fingerprints import from_hex, to_hex
from keepsift.operators.blocks import (
    BLOCK_ROWS,
    PROBE_PAIR_COST,
    ROW_COST,
    bands_for,
    block_forest,
    block_joins,
    block_links,
    block_pairs,
    run_forest,
    scope_sizes,
)
from keepsift.operators.components import connected_components
from keepsift.session import store

BITS = 64
# Rows of one probe key beyond which the key is split by further slices, and comparisons per key.
SPLIT_KEY_ROWS = 30_000
SPLIT_KEY_WORK = SPLIT_KEY_ROWS**2
# Rows that agree on the first bits of a slice and are compared with one another before anything probes, on average.
STAR_ROWS = 1024
# Slices for stars where nothing probes.
STAR_BANDS = 4


def _check(threshold: int) -> None:
    if not 0 <= threshold <= BITS:
        raise ValueError(f"threshold must be within 0..{BITS}")


def distinct_fingerprints(df: DataFrame, fp: str = "fp", by: Sequence[str] = ()) -> DataFrame:
    """One row per fingerprint (and scope). Copies collapse before any comparison."""
    return df.where(F.col(fp).isNotNull()).groupBy(*by, F.col(fp).alias("fp")).agg(F.count(F.lit(1)).alias("copies"))


def similar_pairs(
    df: DataFrame,
    threshold: int = K.DEFAULT_DUPLICATE_THRESHOLD,
    fp: str = "fp",
    by: Sequence[str] = (),
    bands: int | None = None,
    split_rows: int = SPLIT_KEY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by, fp_a, fp_b, distance) for all pairs of different fingerprints with distance <= threshold (0 to 64).

    The number of rows and the threshold decide how pairs are found: `blocks.choose_bands` estimates what probing with
    3 to 8 slices costs, and what comparing all rows of a scope in pairs of blocks costs. `bands` asks for so many
    slices. Without it small tables and wide thresholds are compared by blocks, large tables and narrow ones probe.

    Probing is multi-index hashing with the general pigeonhole bound: of `bands` slices of the 64 bits with
    radii that add up to threshold - bands + 1, at least one differs by no more than its radius.
    Both sides probe with half of the radius, so the join is an equi-join on (slice, value) with
    few probes per row. A pair can meet under several keys; the join condition accepts it only
    under the first slice and the one canonical split of the differing bits, so no distinct
    follows.

    A key with more than `split_rows` rows is not joined as it is: its rows probe again with
    the remaining slices, level by level. Fingerprints are distinct, so what agrees on all but
    one slice is bounded by the values of that slice.
    """
    _check(threshold)
    by = list(by)
    # Stored once: every probe reads the short list, not what it was derived from.
    nodes = store(distinct_fingerprints(df, fp, by).select(*by, "fp"), "fingerprints")
    if not bands:
        bands, squares, largest = bands_for(nodes, by, threshold)
        if not bands:
            return block_pairs(nodes, threshold, by, squares, largest, block_rows)
    plan = _Bands(threshold, bands)
    left = right = nodes.withColumn("used", F.lit(0))
    found, keys = [], list(by)
    for level in range(1, bands + 1):
        left, right = plan.probe(left, level, 0), plan.probe(right, level, 1)
        keys = [*keys, f"k{level}"]
        last = level == bands
        hot = None
        if not last:
            crowded = left.groupBy(*keys).count().where(F.col("count") > split_rows).select(*keys)
            # The keys are collected into a table once; few exist, each stands for > split_rows rows.
            hot = store(crowded, "crowded-keys")
            if hot.isEmpty():
                hot = None
        if hot is None:
            found.append(plan.match(left, right, keys, by, level))
            break
        found.append(
            plan.match(left.join(hot, keys, "left_anti"), right.join(hot, keys, "left_anti"), keys, by, level)
        )
        left, right = left.join(hot, keys, "left_semi"), right.join(hot, keys, "left_semi")
    return reduce(DataFrame.unionByName, found)


def similar_links(
    df: DataFrame, threshold: int = K.DEFAULT_DUPLICATE_THRESHOLD, fp: str = "fp", by: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(by, fp, links) for every distinct fingerprint: how many others `similar_pairs` would list it with. Every pair is
    compared and none is written, so memory and disk grow with the rows."""
    _check(threshold)
    by = list(by)
    nodes = store(distinct_fingerprints(df, fp, by).select(*by, "fp"), "fingerprints")
    _, squares, largest = scope_sizes(nodes, by)
    counted = block_links(nodes, threshold, by, squares, largest, block_rows)
    return nodes.join(counted, [*by, "fp"], "left").select(*by, "fp", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def scope_texts(by: Sequence[str]) -> list[Column]:
    """Scope values as texts that can be joined by "/" without mixing up scopes; NULL is a scope too."""
    out = []
    for c in by:
        text = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        out.append(F.coalesce(F.replace(text, F.lit("/"), F.lit("\\/")) if len(by) > 1 else text, F.lit("\\N")))
    return out


def node_text(by: Sequence[str], fp: Column) -> Column:
    """The name of a fingerprint within its scope, as `fingerprint_clusters` gives it."""
    return F.concat_ws("/", *scope_texts(by), to_hex(fp))


def fingerprint_clusters(
    df: DataFrame,
    threshold: int = K.DEFAULT_DUPLICATE_THRESHOLD,
    fp: str = "fp",
    by: Sequence[str] = (),
    bands: int | None = None,
    split_work: int = SPLIT_KEY_WORK,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(node, root) for every distinct fingerprint: root is the smallest node of its transitive group.

    The groups of `similar_pairs`, found by blocks or by probing as there, without listing the pairs of a dense group.
    Of a table of one block, its spanning forest has the groups. Beyond that, both ways go on as follows:
    - Stars first. Of each slice, fingerprints that agree on its first bits, about `STAR_ROWS` at a time, are joined by
      a spanning forest. This grows with the rows, and joins nearly all of a graph that has many pairs: the more rows
      there are, the more bits agree and the more of the pairs met are close.
    - Then only pairs between different groups matter. By blocks, rows outside of the largest group of their scope are
      compared with all. Probing, rows outside of the largest group of their scope probe, with
      more of the radius the fewer they are; all rows wait under the keys within the rest of the radius. Where that is
      not cheaper, both sides probe with half of it, and per probe key the largest group is set aside: its rows need
      comparing with the others, not among themselves; a key that holds a single group is dropped. What is left goes
      out as distinct pairs of groups.
    - A key on which that is still more than `split_work` comparisons probes again with its other
      slices, as in `similar_pairs`.
    """
    _check(threshold)
    by = list(by)
    df = df.withColumns(dict(zip(by, scope_texts(by), strict=True))) if by else df
    node = F.concat_ws("/", *by, to_hex(F.col("fp")))
    nodes = store(distinct_fingerprints(df, fp, by).select(*by, "fp", node.alias("node")), "fingerprints")
    if not bands:
        bands, squares, largest = bands_for(nodes, by, threshold)
        if not bands and largest <= block_rows:  # one block: its trees are the groups
            edges = block_forest(nodes, threshold, by, squares, largest, block_rows)
            ends = [F.concat_ws("/", *by, to_hex(F.col(c))).alias(c) for c in ("member", "root")]
            roots = store(edges.select(*ends).withColumnRenamed("member", "node"), "trees")
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        if not bands:
            return _clusters_by_blocks(nodes, threshold, by, squares, largest, block_rows)
    plan = _Bands(threshold, bands)

    rows = _starred(plan, nodes, by)
    edges = _joins_of_few(plan, rows, by, bands, split_work)
    if edges is None:
        edges = _joins_of_all(plan, rows, by, bands, split_work)
    joined = connected_components(edges).select(F.col("node").alias("comp"), "root")
    return rows.join(joined, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))


def _near(plan: _Bands, keys: Sequence[str]) -> Column:
    """Rows a and b of different groups that met under the keys and are close."""
    cond = (F.col("a.comp") != F.col("b.comp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= plan.threshold)
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return cond


def _groups_met(a: DataFrame, b: DataFrame, cond: Column) -> DataFrame:
    return a.join(b.hint("merge"), cond).select(F.least("a.comp", "b.comp").alias("a"), F.greatest("a.comp", "b.comp").alias("b")).distinct()


def _joins_of_few(plan: _Bands, rows: DataFrame, by: Sequence[str], bands: int, split_work: int) -> DataFrame | None:
    """(a, b): groups that pairs join, found from the rows outside of the largest group of their scope; None where these are
    so many that probing from all rows is cheaper."""
    few = store(_marked(rows, by).where("_asking").drop("_asking"), "few")
    lean = plan.lean(few.count(), *scope_sizes(rows, by)[:2])
    if lean is None:
        return None
    found, keys = [], list(by)
    left, right = (x.withColumn("used", F.lit(0)) for x in (few, rows))
    for level in range(1, bands + 1):
        # Only the first level knows few from many; what is left after it is crowded on both sides.
        left, right = (plan.probe(x, level, side, lean if level == 1 else None) for side, x in enumerate((left, right)))
        keys = [*keys, f"k{level}"]
        if level == bands:
            found.append(_groups_met(left.alias("a"), right.alias("b"), _near(plan, keys)))
            break
        asked = left.groupBy(*keys).count()
        crowded = asked.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_met")), keys).where(F.col("count") * F.col("_met") > split_work)
        hot = store(crowded.select(*keys), "crowded-keys")
        if hot.isEmpty():
            found.append(_groups_met(left.alias("a"), right.alias("b"), _near(plan, keys)))
            break
        cold = [x.join(hot, keys, "left_anti") for x in (left, right)]
        found.append(_groups_met(cold[0].alias("a"), cold[1].alias("b"), _near(plan, keys)))
        left, right = (x.join(hot, keys, "left_semi") for x in (left, right))
    return reduce(DataFrame.unionByName, found)


def _joins_of_all(plan: _Bands, rows: DataFrame, by: Sequence[str], bands: int, split_work: int) -> DataFrame:
    """(a, b): groups that pairs join, found by probing from all rows."""
    edges = None
    keys, level_rows = list(by), rows.withColumn("used", F.lit(0))
    for level in range(1, bands + 1):
        probes = plan.probe(level_rows, level, 0)
        keys = [*keys, f"k{level}"]
        per_group = probes.groupBy(*keys, "comp").count()
        mixed = per_group.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_groups"),
            F.max_by("comp", "count").alias("_top"),
            (F.sum("count") * (F.sum("count") - F.max("count"))).alias("_work"),
        ).where(F.col("_groups") > 1)
        mixed = mixed.select(*keys, "_top", (F.col("_work") > (split_work if level < bands else 2**62)).alias("_hot"))
        met = probes.join(mixed.hint("merge"), keys)
        if level < bands:
            # Read twice and asked whether anything is left: written once.
            met = store(met, "met")
        cold = met.where(~F.col("_hot"))
        found = _groups_met(cold.where(F.col("comp") != F.col("_top")).alias("a"), cold.alias("b"), _near(plan, keys))
        edges = found if edges is None else edges.unionByName(found)
        if level == bands:
            break
        hot = met.where("_hot")
        if hot.isEmpty():
            break
        level_rows = hot.drop("_top", "_hot")
    return edges


def _starred(plan: _Bands, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, fp, node, comp): the nodes with their groups as stars join them."""
    stars = connected_components(plan.stars(nodes, by))
    return store(nodes.join(stars, "node", "left").select(*by, "fp", "node", F.coalesce("root", "node").alias("comp")), "starred")


def _marked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows, and `_asking`: whether they are outside of the largest group of their scope."""
    sizes = rows.groupBy(*by, "comp").count()
    largest = sizes.groupBy(*by).agg(F.max_by("comp", F.struct("count", "comp")).alias("_largest"))
    met = rows.join(largest, list(by)) if by else rows.crossJoin(F.broadcast(largest))
    return met.withColumn("_asking", F.col("comp") != F.col("_largest")).drop("_largest")


def _clusters_by_blocks(nodes: DataFrame, threshold: int, by: Sequence[str], squares: int, largest: int, block_rows: int) -> DataFrame:
    """(node, root) over many blocks. Stars join most of a large group; then only pairs of blocks with rows outside of the
    largest group of their scope are compared, and give edges between groups."""

    def named(c: str) -> Column:
        return F.concat_ws("/", *by, to_hex(F.col(c))).alias(c)

    rows = _starred(_Bands(threshold, STAR_BANDS), nodes, by)
    # The end of a node's name is its fingerprint.
    asking = _marked(rows, by).select(*by, "fp", from_hex(F.substring("comp", -16, 16)).alias("comp"), "_asking")
    edges = block_joins(asking, threshold, by, squares, largest, block_rows).select(named("a"), named("b"))
    joined = connected_components(edges).select(F.col("node").alias("comp"), "root")
    return rows.join(joined, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))


class _Bands:
    """Slices, radii and probe masks for one threshold."""

    def __init__(self, threshold: int, bands: int):
        self.threshold, self.n = threshold, bands
        base, extra = divmod(64, bands)
        self.width = [base + (i < extra) for i in range(bands)]
        self.offset = [sum(self.width[:i]) for i in range(bands)]

    def radii(self, used: int) -> dict[int, int]:
        """Radius per unused slice; -1 means the slice need not be probed."""
        free = [i for i in range(self.n) if not used >> i & 1]
        budget = self.threshold - len(free) + 1
        if budget < 0:
            # Fewer differing bits than slices: that many + 1 slices, matched exactly, are enough.
            return {i: 0 if j <= self.threshold else -1 for j, i in enumerate(free)}
        base, extra = divmod(budget, len(free))
        return {i: base + (j < extra) for j, i in enumerate(free)}

    def used_sets(self, level: int) -> list[int]:
        return [sum(1 << i for i in c) for c in combinations(range(self.n), level - 1)]

    def slice_of(self, fp: Column, band: int) -> Column:
        return F.shiftrightunsigned(fp, self.offset[band]).bitwiseAND(F.lit((1 << self.width[band]) - 1))

    def stars(self, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
        """True pairs (a, b) that join most rows of a dense group: of every slice, rows that agree on its first bits, so many
        bits that about STAR_ROWS rows do. Where more agree, they are compared in parts."""
        slices = ", ".join(f"struct({i}, {self.offset[i]}, {self.width[i]})" for i in range(self.n))
        sizes = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
        placed = nodes.join(sizes, by) if by else nodes.crossJoin(F.broadcast(sizes))
        rows = placed.select(*by, "fp", "_rows", F.inline(F.expr(f"array({slices})")).alias("_band", "_shift", "_width"))
        bits = F.expr(f"least(_width, greatest(0, cast(floor(log2(_rows / {STAR_ROWS})) AS int)))")
        value = F.expr("shiftrightunsigned(shiftrightunsigned(fp, _shift) & (shiftleft(1L, _width) - 1), _width - _bits)")
        rows = rows.withColumn("_bits", bits).select(*by, "fp", "_band", "_bits", value.alias("_value"))
        crowds = rows.groupBy(*by, "_band", "_value").agg(F.ceil(F.count(F.lit(1)) / (2 * STAR_ROWS)).alias("_parts"))
        # A scope that is one part is the same one by every slice.
        rows = rows.join(crowds, [*by, "_band", "_value"]).where("_band = 0 OR _bits > 0 OR _parts > 1")
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("fp", "_band"), F.col("_parts"))).drop("_bits", "_parts")
        found = run_forest(rows, self.threshold, by, ["_band", "_value", "_part"], nodes.count() * self.n * STAR_ROWS)
        return found.select(*[F.concat_ws("/", *by, to_hex(F.col(c))).alias(x) for c, x in (("root", "a"), ("member", "b"))])

    def lean(self, few: int, rows: int, squares: int) -> int | None:
        """Bits that waiting rows flip at the first level where `few` rows probe with the rest of the radius, at the least
        estimated cost; None where probing from all rows costs less."""
        radii = {i: r for i, r in self.radii(0).items() if r >= 0}

        def reach(band: int, flips: int) -> int:
            return sum(comb(self.width[band], k) for k in range(flips + 1))

        def cost(asking: int, waiting: int, flips: dict[int, tuple[int, int]]) -> tuple[int, float]:
            reached = [(reach(band, p), reach(band, q), 2 ** self.width[band]) for band, (p, q) in flips.items()]
            probes = sum(asking * a + waiting * b for a, b, _ in reached)
            return probes, ROW_COST * probes + PROBE_PAIR_COST * few * squares / max(1, rows) * sum(a * b / n for a, b, n in reached)

        # From all rows, one set of probes is both sides. More rows than these are never sent.
        best, (most, least) = None, cost(rows, 0, {i: ((r + 1) // 2,) * 2 for i, r in radii.items()})
        for q in range(max(radii.values()) // 2, -1, -1):
            probes, now = cost(few, rows, {i: (r - min(q, r // 2), min(q, r // 2)) for i, r in radii.items()})
            if probes <= most and now < least:
                best, least = q, now
        return best

    def masks(self, band: int, bits: int) -> list[int]:
        return [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(self.width[band]), k)]

    def _probes(self, used: int, side: int, lean: int | None = None) -> Column:
        """All (slice, shift, slice mask, flipped bits) a row tries, as one literal array. With `lean`, rows of side 1 flip
        no more bits than that and those of side 0 all others of the radius; else each flips half of it."""
        out = []
        for band, radius in self.radii(used).items():
            if radius < 0:
                continue
            waiting = radius // 2 if lean is None else min(lean, radius // 2)
            flips = ", ".join(f"{m}L" for m in self.masks(band, radius - waiting if side == 0 else waiting))
            out.append(f"struct({band}, {self.offset[band]}, {(1 << self.width[band]) - 1}L, array({flips}))")
        return F.expr(f"array({', '.join(out)})")

    def probe(self, df: DataFrame, level: int, side: int, lean: int | None = None) -> DataFrame:
        """Rows times their probe keys at this level: k = slice value with some bits of the radius flipped."""
        sets = self.used_sets(level)
        probes = self._probes(sets[0], side, lean)
        for used in sets[1:]:
            probes = F.when(F.col("used") == used, self._probes(used, side, lean)).otherwise(probes)
        rows = df.select("*", F.inline(probes).alias("_band", "_shift", "_ones", "_flips"))
        rows = rows.select(*df.columns, "_band", "_shift", "_ones", F.explode("_flips").alias(f"m{level}"))
        value = F.expr("shiftrightunsigned(fp, _shift)").bitwiseAND(F.col("_ones")).bitwiseXOR(F.col(f"m{level}"))
        return rows.withColumns(
            {
                f"u{level}": F.col("used"),
                f"b{level}": F.col("_band"),
                f"k{level}": F.shiftleft(F.col("_band").cast("bigint"), 40).bitwiseOR(value),
                "used": F.col("used").bitwiseOR(F.expr("shiftleft(1, _band)")),
            }
        ).drop("_band", "_shift", "_ones")

    def match(self, left: DataFrame, right: DataFrame, keys, by, level: int) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        cond = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= self.threshold)
        for k in keys:
            cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        for lv in range(1, level + 1):
            cond = cond & self._canonical(lv) & self._first(diff, lv)
        # Size estimates do not see the probes multiply the rows, so broadcasting is ruled out.
        return a.join(b.hint("merge"), cond).select(
            *[F.col(f"a.{c}").alias(c) for c in by],
            F.col("a.fp").alias("fp_a"),
            F.col("b.fp").alias("fp_b"),
            F.bit_count(diff).cast("int").alias("distance"),
        )

    @staticmethod
    def _canonical(level: int) -> Column:
        """Left flipped the lower half of the differing bits (one more if odd), right the upper half."""
        ma, mb = F.col(f"a.m{level}"), F.col(f"b.m{level}")
        lowest_b = mb.bitwiseAND(-mb)
        return ((mb == 0) | (ma < lowest_b)) & (F.bit_count(ma) - F.bit_count(mb)).between(0, 1)

    def _first(self, diff: Column, level: int) -> Column:
        """No earlier unused slice is within its radius."""
        out = F.lit(False)
        for used in self.used_sets(level):
            radii = {i: r for i, r in self.radii(used).items() if r >= 0}
            for band in radii:
                ok = (F.col(f"a.u{level}") == used) & (F.col(f"a.b{level}") == band)
                for i, r in radii.items():
                    if i < band:
                        ok = ok & (F.bit_count(self.slice_of(diff, i)) > r)
                out = out | ok
        return out
