"""Pairs against brute force, components against union-find."""

import random

import numpy as np
import pytest

from keepsift.operators import blocks, components, similarity
from keepsift.operators.blocks import bands_for, block_joins, choose_bands
from keepsift.operators.components import FEW_EDGES, connected_components
from keepsift.operators.grouping import cluster_rows, group_duplicates
from keepsift.operators.similarity import fingerprint_clusters, similar_links, similar_pairs

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(seed=1):
    """Balls around a few centres, random ones, and many that share one 16-bit slice."""
    rnd = random.Random(seed)
    out = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rnd.randint(0, 9)):
                x ^= 1 << rnd.randint(0, 63)
            out.add(x)
    out |= {(0xABCD << 48) | rnd.getrandbits(48) & 0x0000_0FFF_FFF0_FFF0 for _ in range(120)}
    return sorted(signed(x) for x in out)


def brute(fps, t):
    return sorted((a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & MASK).count("1") <= t)


@pytest.mark.parametrize("threshold, split", [(0, 10**6), (2, 10**6), (5, 10**6), (10, 10**6), (10, 100), (6, 60), (20, 10**6)])
def test_pairs_equal_brute_force(spark, threshold, split):
    fps = prints()
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = similar_pairs(df, threshold, split_rows=split, bands=4).collect()
    assert sorted((r.fp_a, r.fp_b) for r in got) == brute(fps, threshold)


@pytest.mark.parametrize("threshold, block", [(0, 4096), (10, 4096), (20, 50), (21, 4096), (28, 40), (33, 4096), (64, 60)])
def test_pairs_by_blocks_equal_brute_force(spark, threshold, block):
    fps = prints(3)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = similar_pairs(df, threshold, block_rows=block).collect()
    assert sorted((r.fp_a, r.fp_b, r.distance) for r in got) == [
        (a, b, bin((a ^ b) & MASK).count("1")) for a, b in brute(fps, threshold)
    ]


def test_the_cheaper_way_is_taken():
    assert choose_bands(1000, 1000**2, 10) == 0  # few rows: blocks
    assert choose_bands(10**6, 10**12, 10) > 0  # many rows and a narrow threshold: probes
    assert choose_bands(10**8, 10**16, 3) > 0
    assert choose_bands(10**8, 10**16, 40) == 0  # slices tell nothing apart
    assert choose_bands(10**6, 10**6 * 100, 10) == 0  # many small scopes


def test_blocks_stay_in_their_scope(spark):
    fps = prints(4)
    df = spark.createDataFrame([(f"s{i % 3}" if i % 7 else None, x) for i, x in enumerate(fps)], "scope string, fp long")
    got = sorted((r.scope, r.fp_a, r.fp_b) for r in similar_pairs(df, 24, by=["scope"], block_rows=30).collect())
    want = []
    for s in ("s0", "s1", "s2"):
        want += [(s, a, b) for a, b in brute([x for i, x in enumerate(fps) if i % 7 and f"s{i % 3}" == s], 24)]
    assert got == sorted(want)


def test_pairs_stay_in_their_folder(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 1), ("y", 5)], "folder string, fp long")
    got = similar_pairs(df, 3, by=["folder"]).collect()
    assert sorted((r.folder, r.fp_a, r.fp_b) for r in got) == [("x", 1, 3), ("y", 1, 5)]


PROBES = [(t, {"split_work": w, "bands": 4}) for t, w in [(0, 10**9), (3, 10**9), (10, 10**9), (10, 400), (6, 100), (18, 10**9)]]
BLOCKS = [(t, {"block_rows": r}) for t, r in [(0, 4096), (10, 4096), (10, 40), (22, 50), (26, 4096), (40, 30), (64, 4096)]]


@pytest.mark.parametrize("threshold, options", [*PROBES, *BLOCKS])
def test_clusters_equal_the_pairs(spark, threshold, options):
    fps = prints(2)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(fps, threshold):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in fingerprint_clusters(df, threshold, **options).collect()}
    name = {x: f"{x & MASK:016x}" for x in fps}
    groups = {}
    for x in fps:
        groups.setdefault(find(x), []).append(name[x])
    assert got == {m: min(g) for g in groups.values() for m in g}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 220), rnd.randint(100, 220)) for _ in range(90)] + [(500, 500 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (FEW_EDGES, 0):
        assert {r.node: r.root for r in connected_components(df, few=few).collect()} == want
    texts = connected_components(df.selectExpr("lpad(a, 4, '0') AS a", "lpad(b, 4, '0') AS b"))
    assert {int(r.node): int(r.root) for r in texts.collect()} == want


def test_a_dense_graph_is_folded_before_it_is_shuffled(spark):
    edges = spark.range(300).selectExpr("id AS a").crossJoin(spark.range(300).selectExpr("id AS b")).coalesce(4)
    ends = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v")
    assert components._folded(ends).count() <= 4 * 299
    assert {(r.node, r.root) for r in connected_components(edges, few=0).collect()} == {(i, 0) for i in range(300)}


def test_links_equal_brute_force(spark):
    fps = prints(6)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {x: 0 for x in fps}
    for a, b in brute(fps, 12):
        want[a] += 1
        want[b] += 1
    for rows in (4096, 30):
        assert {r.fp: r.links for r in similar_links(df.unionByName(df), 12, block_rows=rows).collect()} == want


def test_crowded_slices_are_compared_by_blocks(spark):
    """The same number of rows: random ones probe, ones that share most of their bits do not."""
    n = 200_000
    random_ones = spark.range(n).selectExpr("xxhash64(id) AS fp")
    alike = random_ones.selectExpr("fp & 15762873573703680 AS fp").union(spark.range(n - 1000).selectExpr("id AS fp")).distinct()
    assert bands_for(random_ones, [], 10)[0] > 0
    assert bands_for(alike, [], 10)[0] == 0


def test_clusters_by_blocks_compare_few_rows_with_all(spark, monkeypatch):
    """What stars leave outside of the largest group of a scope meets all rows; the others do not meet one another."""
    monkeypatch.setattr(similarity, "STAR_ROWS", 20)
    asked = []

    def spy(nodes, *rest):
        asked.append((nodes.where("_asking").count(), nodes.count()))
        return block_joins(nodes, *rest)

    monkeypatch.setattr(similarity, "block_joins", spy)
    rnd = random.Random(11)
    crowd, link = rnd.getrandbits(64), rnd.getrandbits(64)
    fps = {crowd ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(500)}
    for _ in range(30):  # chains away from the crowd, and rows alone
        link ^= sum(1 << b for b in rnd.sample(range(64), 8))
        fps |= {link, rnd.getrandbits(64)}
        crowd ^= sum(1 << b for b in rnd.sample(range(64), 7))
        fps.add(crowd)
    fps = sorted(signed(x) for x in fps)
    want = {}
    for scope in "ab":
        here = [x for i, x in enumerate(fps) if scope == "a" or i % 2]
        root = {x: x for x in here}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in brute(here, 10):
            root[find(a)] = find(b)
        groups = {}
        for x in here:
            groups.setdefault(find(x), []).append(f"{scope}/{x & MASK:016x}")
        want |= {m: min(g) for g in groups.values() for m in g}
    df = spark.createDataFrame([("a", x) for x in fps] + [("b", x) for x in fps[1::2]], "scope string, fp long")
    assert {r.node: r.root for r in fingerprint_clusters(df, 10, by=["scope"], block_rows=40).collect()} == want
    assert {f"a/{r.node}": f"a/{r.root}" for r in fingerprint_clusters(df, 10, block_rows=40).collect()} == {k: v for k, v in want.items() if k < "b"}
    assert len(asked) == 2 and all(0 < few < rows / 3 for few, rows in asked)


def test_tiles_have_all_near_pairs_and_pass_over_far_rows():
    rnd = np.random.default_rng(4)
    centres = rnd.integers(0, 2**64, 3, np.uint64)
    for n, m in ((3000, 2501), (1, 5), (70, 1), (0, 3)):
        one, other = (centres[np.arange(k) % 3] ^ (np.uint64(1) << rnd.integers(0, 64, k).astype(np.uint64)) for k in (n, m))
        found, compared = np.zeros((n, m), bool), 0
        for some, met, near in blocks.near_tiles(one, other, 2):
            found[np.ix_(some, met)] |= near
            compared += near.size
        assert (found == (np.bitwise_count(one[:, None] ^ other[None, :]) <= 2)).all()
        assert n * m < 1000 or compared < 0.5 * n * m


def test_links_over_many_blocks(spark):
    """Blocks grow with the rows, so a row does not travel once for every 16,384 others; scopes are kept apart."""
    assert [blocks.grown_rows(n, 16_384) for n in (10, 400_000, 2_600_000, 10**8)] == [16_384, 16_384, 81_250, 262_144]
    fps = prints(8)
    rows = [(s, x) for s in ("a", "b", None) for x in fps if s != "b" or x % 3]
    want = {}
    for scope, here in (("a", fps), ("b", [x for x in fps if x % 3])):
        want |= {(scope, x): 0 for x in here}
        for pair in brute(here, 12):
            for x in pair:
                want[scope, x] += 1
    df = spark.createDataFrame(rows, "scope string, fp long")
    for size in (4096, 7):
        got = {(r.scope, r.fp): r.links for r in similar_links(df, 12, by=["scope"], block_rows=size).collect()}
        assert {k: v for k, v in got.items() if k[0]} == want and len(got) == len(rows)


def test_known_groups_are_not_joined_again(spark):
    """Blocks of one group give no edges: only pairs between groups do."""
    rows = [(i, 0) for i in range(400)] + [(i + (1 << 40), 1 << 40) for i in range(3)]
    df = spark.createDataFrame(rows, "fp long, comp long")
    got = block_joins(df, 9, [], 403**2, 403, 40).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} <= {(0, 1 << 40)} and len(got) <= 2
    assert block_joins(df.withColumn("comp", df.fp * 0), 9, [], 403**2, 403, 40).count() == 0


@pytest.mark.parametrize("threshold, bands, split", [(18, 4, 10**9), (10, 4, 400), (9, 3, 10**9)])
def test_clusters_by_few_rows_equal_brute_force(spark, monkeypatch, threshold, bands, split):
    """Only rows outside of the largest group probe, with every share of the radius, and no pair is lost."""
    monkeypatch.setattr(similarity, "STAR_ROWS", 40)
    rnd = random.Random(threshold)
    fps = set(prints(7))
    for centre in [rnd.getrandbits(64) for _ in range(3)]:
        for _ in range(60):  # chains away from a large group
            centre ^= sum(1 << b for b in rnd.sample(range(64), min(threshold, 9)))
            fps.add(signed(centre))
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(fps, threshold):
        root[find(a)] = find(b)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), []).append(f"{x & MASK:016x}")
    want = {m: min(g) for g in groups.values() for m in g}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for lean in (0, 1):
        monkeypatch.setattr(similarity._Bands, "lean", lambda *_, lean=lean: lean)
        assert {r.node: r.root for r in fingerprint_clusters(df, threshold, bands=bands, split_work=split).collect()} == want


def test_probes_grow_with_the_rows():
    """Once few rows are outside of the largest group, all others wait under one key for each slice."""
    plan = similarity._Bands(18, 4)
    assert plan.lean(10**6, 10**6, 10**12) is None
    assert plan.lean(600, 10**4, 10**8) is not None
    assert plan.lean(100, 10**6, 10**12) == 0 == plan.lean(0, 10**6, 10**12)


def test_stars_join_a_graph_of_many_pairs(spark):
    """Random fingerprints, each with some ten others in reach, are one group but for a few before any row probes."""
    nodes = spark.range(30_000).selectExpr("xxhash64(id) AS fp").selectExpr("fp", "lpad(lower(hex(fp)), 16, '0') AS node")
    roots = connected_components(similarity._Bands(18, 4).stars(nodes, [])).groupBy("root").count()
    assert roots.agg({"count": "max"}).first()[0] > 28_000


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def assets(spark, hexes):
    rows = [(str(i), f"IMG_{i}.jpg", f"/p/IMG_{i}.jpg", h) for i, h in enumerate(hexes)]
    df = spark.createDataFrame(rows, "image_id string, filename string, path string, hex string")
    from pyspark.sql import functions as F

    from keepsift.functions.fingerprints import from_hex

    return df.withColumn("fp", from_hex(F.col("hex")))


def test_three_and_one(spark):
    rows = group_duplicates(assets(spark, ["d5c86c4f8a3b1e2d", "d5c86c4f8a3b1e2c", "d5c86c4f8a3b1e2b", "deadbeefdeadbeef"]), 10)
    assert sorted(r["size"] for r in cluster_rows(rows).collect()) == [1, 3]
    assert sorted(r.image_id for r in rows.where("is_representative").collect()) == ["0", "3"]


def test_threshold_zero_missing_and_empty(spark):
    two = assets(spark, ["d5c86c4f8a3b1e2d", "d5c86c4f8a3b1e2c", None, None, "d5c86c4f8a3b1e2d"])
    assert cluster_rows(group_duplicates(two, 0)).count() == 4
    assert group_duplicates(two.limit(0), 10).count() == 0
    assert group_duplicates(two, disabled=True).where("is_representative").count() == 5


def test_threshold_range(spark):
    for t in (-1, 65):
        with pytest.raises(ValueError):
            similar_pairs(spark.createDataFrame([(1,)], "fp long"), t)


def test_fingerprint_may_be_a_function(spark):
    from pyspark.sql import functions as F

    rows = assets(spark, ["00" * 8, "00" * 8, "ff" * 8])
    got = group_duplicates(rows.drop("fp"), 3, lambda df: F.crc32(F.encode("hex", "utf-8")))
    assert got.where("is_representative").count() == 2


def test_simhash_of_texts(spark):
    from keepsift.functions.fingerprints import simhash

    df = spark.createDataFrame([(1, "Red fox, red dog"), (2, "red FOX red dog"), (3, " .. "), (4, None)], "id long, text string")
    got = {r.id: r.fp for r in simhash(df, "id", "text").collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] is None


def test_scopes_are_kept_apart(spark):
    from keepsift.operators.grouping import group_duplicates

    rows = [("1", "x.jpg", "p1", 5, "a/b", "c"), ("2", "y.jpg", "p2", 5, "a", "b/c"), ("3", "z.jpg", "p3", 5, None, "c"), ("4", "w.jpg", "p4", 5, None, "c")]
    df = spark.createDataFrame(rows, "image_id string, filename string, path string, fp bigint, s1 string, s2 string")
    got = {r.image_id: r.cluster_id for r in group_duplicates(df, 2, by=("s1", "s2")).collect()}
    assert len(got) == 4 and got["1"] != got["2"] and got["3"] == got["4"]


def test_hamming_of_odd_and_long_texts(spark):
    from pyspark.sql import functions as F

    from keepsift.functions.fingerprints import hamming_hex

    cases = [("fff", "ff0f", 0), ("f", "0f", 0), ("f", "f0", 8), ("", "ff", 8), ("0" * 66, "0" * 64 + "ff", 0), ("f" * 65, "0" * 64, 256)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    assert df.where(hamming_hex(F.col("a"), F.col("b")) != F.col("want")).count() == 0
