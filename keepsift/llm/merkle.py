"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and proofs by octopus multiproofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral, numbered
from keepsift.session import store

#: Children of a node; levels of the tree that one leaf partition spans, which so holds RUN ** HEIGHT leaves.
RUN, HEIGHT = 16, 3
#: Rows with proofs that leave a task at once.
ROWS = 512
#: Tree of the rows of a group, and tree of the groups.
ROWS_TREE, GROUPS_TREE = 0, 1

Coordinate = tuple[int, int]


def node(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(c: Column) -> Column:
    """The value with its length before it, so that no two rows read alike; `-` for NULL."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def levels_above(n: int, run: int = RUN) -> int:
    """Levels above n nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // run), k + 1
    return k


def _levels_above(n: Column, run: int) -> Column:
    out, k = F.lit(0), 1
    while run ** (k - 1) < 2**62:
        out, k = F.when(n > run ** (k - 1), F.lit(k)).otherwise(out), k + 1
    return out


def missing(known: Iterable[int], n: int, run: int = RUN, level: int = 0) -> list[Coordinate]:
    """(level, place) of the fewest nodes that, with the known ones of `level`, give all nodes above them.

    `n` is the number of nodes at `level`. A sibling that is known, or that known nodes give, is left out.
    """
    need, known = [], set(known)
    while n > 1:
        above = sorted({k // run for k in known})
        need += [(level, p) for r in above for p in range(r * run, min(n, (r + 1) * run)) if p not in known]
        known, n, level = set(above), -(-n // run), level + 1
    return need


def climbed(digests: list[str], levels: int, run: int = RUN) -> list[list[str]]:
    """The nodes of each level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([node("".join(below[i : i + run])) for i in range(0, len(below), run)])
    return out


def _packed(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes (grp, top, pos, digest) as one row for each `size` neighbours of a group."""
    held = F.sort_array(F.collect_list(F.struct("pos", "digest")))
    return nodes.groupBy("grp", "top", F.expr(f"pos div {size}").alias("block")).agg(held["digest"].alias("digests"))


def _climb(run: int, height: int, base: int, all_levels: bool):
    """Packed nodes of level `base` -> the nodes above them in reach; without `all_levels` the highest ones only."""
    names = ["grp", "top", "level", "pos", "digest"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                grp, top, block, digests = (c[i].as_py() for c in b.columns)
                found = climbed(digests, min(height, top - base), run)
                for k, level in enumerate(found):
                    if (k and all_levels) or k == len(found) - 1:
                        first = block * run ** (height - k)
                        rows += [(grp, top, base + k, first + p, d) for p, d in enumerate(level)]
                if len(rows) > 20 * ROWS:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return work, "grp long, top int, level int, pos long, digest string"


def _tree(nodes: DataFrame, level: int, most: int, run: int, height: int, name: str) -> DataFrame:
    """`nodes` (grp, top, level, pos, digest) of `level` and all nodes above them; `most` is the largest top."""
    out = nodes
    while level < most:
        packed = _packed(nodes.where((F.col("level") == level) & (F.col("top") > level)), run**height)
        nodes = store(packed.mapInArrow(*_climb(run, height, level, True)), f"{name}-{level}")
        out, level = out.unionByName(nodes), level + height
    return out


def _ask(run: int, height: int, groups: int):
    """Leaf partitions (grp, block, n, top) -> the coordinates that each has to fetch."""
    names = ["grp", "block", "tree", "of", "level", "pos"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for grp, block, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                blocks = -(-n // run**height)
                rows += [(grp, block, ROWS_TREE, grp, *at) for at in missing([block], blocks, run, height)]
                rows += [(grp, block, GROUPS_TREE, 0, *at) for at in missing([grp], groups, run)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return work, "grp long, block long, tree int, of long, level int, pos long"


class Way:
    """What stands before and after a node in its run, level by level."""

    def __init__(self):
        self.before, self.after, self.places = [], [], []

    def add(self, run: list[str], place: int) -> None:
        self.before.append("".join(run[:place]))
        self.after.append("".join(run[place + 1 :]))
        self.places.append({"place": place, "size": len(run)})

    def proof(self) -> str:
        return "".join(b + a for b, a in zip(self.before, self.after, strict=True))

    def folded(self, digest: str) -> str:
        for b, a in zip(self.before, self.after, strict=True):
            digest = node(b + digest + a)
        return digest


def folded(leaf: str, proof: str, places: Sequence[dict], width: int = 64) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for x in places:
        others = proof[at : at + (x["size"] - 1) * width]
        at += len(others)
        cut = x["place"] * width
        leaf = node(others[:cut] + leaf + others[cut:])
    return leaf


def _outside(fetched: list[dict], grp: int, block: int, n: int, groups: int, run: int, height: int) -> list[tuple[list[str], int]]:
    """(siblings, own place) for each level above a leaf partition, through both trees."""
    held = {(x["tree"], x["level"], x["pos"]): x["digest"] for x in fetched}
    out = []
    for tree, level, at, count in ((ROWS_TREE, height, block, -(-n // run**height)), (GROUPS_TREE, 0, grp, groups)):
        while count > 1:
            first = at // run * run
            others = [held[tree, level, p] for p in range(first, min(count, first + run)) if p != at]
            out.append((others, at - first))
            level, at, count = level + 1, at // run, -(-count // run)
    return out


def _expand(run: int, height: int, groups: int):
    """Leaf partitions with what they fetched -> a row for every leaf with its own proof."""
    names = ["doc_id", "source", "pos", "leaf", "subroot", "places", "proof", "folded_root"]
    places = pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), places, pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                source, grp, block, n, top, leaves, fetched = (c[i].as_py() for c in b.columns)
                inside = climbed([x["leaf"] for x in leaves], min(height, top), run)
                # Shared by all leaves of the partition: the way from its highest node to the root.
                shared, digest, subroot = Way(), inside[-1][0], None
                outside = _outside(fetched or [], grp, block, n, groups, run, height)
                for k, (others, place) in enumerate(outside):
                    if k == max(0, top - height):
                        subroot = digest
                    siblings = [*others[:place], digest, *others[place:]]
                    shared.add(siblings, place)
                    digest = node("".join(siblings))
                root, subroot = digest, subroot or digest
                rest = shared.proof()
                # Shared by the leaves below a node: what stands beside it.
                beside = []
                for level in inside[:-1]:
                    beside.append([])
                    for first in range(0, len(level), run):
                        siblings = level[first : first + run]
                        for p in range(len(siblings)):
                            beside[-1].append(("".join(siblings[:p]), "".join(siblings[p + 1 :]), {"place": p, "size": len(siblings)}))
                rows = []
                for p, x in enumerate(leaves):
                    way = [beside[k][p // run**k] for k in range(len(beside))]
                    got = root
                    if x["claimed"] != x["leaf"]:
                        got = x["claimed"]
                        for before, after, _ in way:
                            got = node(before + got + after)
                        got = shared.folded(got)
                    proof = "".join(part for before, after, _ in way for part in (before, after)) + rest
                    rows.append((x["doc_id"], source, x["pos"], x["leaf"], subroot, [w[2] for w in way] + shared.places, proof, got))
                    if len(rows) == ROWS or p == len(leaves) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []

    return work, (
        "doc_id long, source string, pos long, leaf string, subroot string, places array<struct<place:int,size:int>>, proof string, folded_root string"
    )


def merkle_manifest(
    df: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    claimed: Column | None = None,
    run: int = RUN,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per input row: doc_id, source, leaf, subroot, root, places, proof, folded_root, verified.

    A leaf is the SHA-256 of the row's columns. The leaves of a group, by id, are the lowest nodes of the group's
    tree, in which every `run` neighbours have one node above them; the groups' roots are in the same way the lowest
    nodes of a tree over the groups. `proof` lists the digests beside a leaf's way to the root, level by level, and
    `places` where the way goes; `folded` recomputes a root from them. `claimed` is the digest that a row's present
    content gives (by default the leaf itself): `folded_root` follows from it and the row's proof, and `verified`
    tells whether that is the root.

    Octopus multiproof: a leaf partition is `run ** height` neighbouring leaves of a group. It computes the fewest
    nodes that it lacks for all its proofs (`missing`; what its own leaves give is not among them), fetches these
    in one join, derives the nodes that its leaves share, and expands the proof of each leaf by itself. No text is
    shuffled, only digests; a large group is many leaf partitions.

    Defined cases: NULL ids come first; rows with equal ids are ordered by their leaf, so repeated rows have equal
    leaves side by side. NULL is a group of its own, before all others. An empty text is not NULL. A group of one
    row has that row's leaf as its root, and a table of one group that group's. Empty tables give no rows. Only the
    named columns are read, whatever others there are.
    """
    group = df[group_col].cast("string")
    leaf = leaf_digest([df[c] for c in columns])
    rows = df.select(integral(df, id_col).alias("doc_id"), group.alias("source"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed"))
    placed = numbered(rows, "pos", ["doc_id", "leaf", "claimed"], ["source"])
    placed = store(placed, "leaves")
    counted = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = store(numbered(counted, "grp", ["source"]).withColumn("top", _levels_above(F.col("n"), run)), "groups")
    groups, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("top"), F.lit(0))).first()

    # Leaf partitions: one row for each.
    size = run**height
    packed = placed.groupBy("source", F.expr(f"pos div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "claimed"))).alias("leaves")
    )
    of = sources.withColumnRenamed("source", "_source")
    blocks = store(packed.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "blocks")

    # Both trees above the leaf partitions.
    highest = blocks.select("grp", "top", "block", F.col("leaves.leaf").alias("digests")).mapInArrow(*_climb(run, height, 0, False))
    of_rows = _tree(store(highest, "nodes"), height, most, run, height, "nodes")
    roots = of_rows.where("level = top").select(
        F.lit(0).cast("long").alias("grp"), F.lit(levels_above(groups, run)).alias("top"), F.lit(0).alias("level"), F.col("grp").alias("pos"), "digest"
    )
    of_groups = _tree(store(roots, "subroots"), 0, levels_above(groups, run), run, height, "subroots")
    found = of_groups.where("level = top").select("digest").first()
    root = F.lit(found["digest"] if found else None).cast("string")

    asked = blocks.select("grp", "block", "n").mapInArrow(*_ask(run, height, groups))
    nodes = of_rows.withColumn("tree", F.lit(ROWS_TREE)).unionByName(of_groups.withColumn("tree", F.lit(GROUPS_TREE)))
    nodes = nodes.select("tree", F.col("grp").alias("of"), "level", "pos", "digest")
    fetched = asked.join(nodes, ["tree", "of", "level", "pos"]).groupBy("grp", "block").agg(
        F.collect_list(F.struct("tree", "level", "pos", "digest")).alias("fetched")
    )
    met = blocks.join(fetched, ["grp", "block"], "left").select("source", "grp", "block", "n", "top", "leaves", "fetched")
    out = met.mapInArrow(*_expand(run, height, groups)).withColumn("root", root)
    return out.select(
        "doc_id", "source", "leaf", "subroot", "root", "places", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered(df: DataFrame, columns: Sequence[str], id_col: str, text_col: str, every: int = 5) -> Column:
    """The leaf of a row once its text has lost its capital letters A-Z, where `every` divides the CRC-32 of the id."""
    low = F.translate(df[text_col], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % every == 0, F.lit(False))
    text = F.when(hit, low).otherwise(df[text_col])
    return leaf_digest([text if c == text_col else df[c] for c in columns])
