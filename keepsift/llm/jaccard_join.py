"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keepsift.llm.common import batch_bytes, integral, reader_rows
from keepsift.llm.words import Words, chunks, mixed, ngrams, powers
from keepsift.operators.components import connected_components
from keepsift.session import store

SHINGLE = 5
#: Similarity of 3/4 or more links: overlap >= 3/7 of both sizes together.
NUMERATOR, DENOMINATOR = 3, 4
#: Most shared prefix tokens that a document may ask for.
MOST_MATCHES = 4
#: What a candidate costs to verify, in postings read.
VERIFY_COST = 20
#: Common tokens that are known to every task, the most frequent ones: a bound on what is sent out (16 bytes each).
MOST_COMMON = 1 << 18
#: Texts of one task that have to hold a token before it is reported, and of all before it counts as common.
SEEN_BY_TASK, LEAST_COMMON = 2, 4
#: Members of a component that stand for it before a document that shares a minimum with it.
DELEGATES = 4
#: Times that strays meet delegates, other ones each time.
STRAY_TURNS = 3
#: Links that one task may join to components; more go through rounds over all tasks.
FEW_LINKS = 100_000
#: 64-bit words of a sketch in which every token turns one bit over.
SKETCH = 8
#: Tokens that a task counts at once when it looks for common ones.
COUNTED = 1_000_000
#: Bytes of an Arrow batch: texts, bit maps and token sets are handled a few at a time, so small batches cost no work.
BATCH_BYTES = 1_000_000
#: Rows that Parquet is read at a time, for the same reason: a batch of texts lies in one piece of the heap.
READ_ROWS = 512
#: Bytes of text turned into tokens at once: the arrays for it take some fifty times as much.
TEXT_BYTES = 250_000
#: Hashes that choose the first partner of a document.
SEEDS = tuple(0x9E3779B97F4A7C15 * i & (2**64 - 1) for i in range(1, 7))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): the distinct shingle hashes of each text in ascending order, and where each text's begin and end.

    Words are lower-cased in A-Z. A text with fewer words than a shingle is one token, without words none.
    """
    words = Words(_FOLD[data], offsets)
    hashes = words.hashes()
    count = words.high - words.low
    at = np.flatnonzero(np.arange(len(words)) + size <= words.high[words.text])
    text, token = [words.text[at]], [ngrams(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)]
    for short in range(1, size):
        few = np.flatnonzero(count == short)
        value = np.full(len(few), short, np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j, p in enumerate(powers(0xE7037ED1A0B428DB, short)):
            value += hashes[words.low[few] + j] * p
        text.append(few)
        token.append(mixed(value))
    text, token = np.concatenate(text), np.concatenate(token)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    text, token = text[new], token[new]
    return token, np.searchsorted(text, np.arange(len(offsets)))


def signature(tokens: np.ndarray) -> bytes:
    """A bit map of the tokens with four to eight bits each, a power of two in all."""
    bits = 1 << max(3, (4 * len(tokens) - 1).bit_length())
    row = np.zeros(bits, bool)
    row[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").tobytes()


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits, each the parity of the tokens that hash to it: two sketches differ in no more bits than their sets in tokens."""
    # Not the low bits, which place tokens in the bit map.
    count = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def most_overlap(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """An upper bound of the overlap: a bit of one map that the other lacks stands for a token that the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(m.reshape(-1, size), 0) for m in (x, y))
    return min(n_a - int(_POPULATION[x & ~y].sum()), n_b - int(_POPULATION[y & ~x].sum()))


def linked(overlap: int, n_a: int, n_b: int) -> bool:
    return DENOMINATOR * overlap >= NUMERATOR * (n_a + n_b - overlap)


def _profiles(size: int):
    """Per text: size, digest of the set, minima, bit map and sketch; and the tokens common in what a task has counted."""
    names = ["kind", "id", "n", "digest", "minima", "bits", "odd"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = set()

        def common():
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = n >= SEEN_BY_TASK
            k = int(often.sum())
            none = [None] * k
            data = [[1] * k, token[often].view(np.int64), n[often], none, none, none, none]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names)

        for b in batches:
            for i, j, data, offsets in chunks(b.column(1), TEXT_BYTES):
                token, ends = shingle_sets(data, offsets, size)
                n = np.diff(ends)
                full = np.flatnonzero(n)
                minima = [[]] * len(n)
                if len(full):
                    mins = np.stack([np.minimum.reduceat(mixed(token ^ np.uint64(s)), ends[full]) for s in SEEDS], 1).view(np.int64)
                    minima = [[]] * len(n)
                    for t, m in zip(full.tolist(), mins.tolist(), strict=True):
                        minima[t] = m
                digests, bits, odd, fresh = [], [], [], []
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    digests.append(hashlib.blake2b(token[s:e].tobytes(), digest_size=16).digest())
                    bits.append(signature(token[s:e]) if e > s else b"")
                    odd.append(odd_sketch(token[s:e]))
                    if digests[-1] not in seen:  # equal sets count once
                        seen.add(digests[-1])
                        fresh.append(token[s:e])
                arrays = [pa.array([0] * len(n), pa.int32()), b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *[pa.array(x, t) for x, t in zip((digests, minima, bits, odd), kinds[3:], strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names)
                held += fresh
                if sum(map(len, held)) >= COUNTED:
                    yield common()
                    held, seen = [], set()
        yield common()

    return run, "kind int, id long, n long, digest binary, minima array<long>, bits binary, odd array<long>"


def _postings(size: int, common: np.ndarray, times: np.ndarray):
    """(token, id, n, place, need) of every prefix token; rare tokens come first, common ones last by how common they are."""
    names = ["token", "id", "n", "place", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, offsets in chunks(b.column(1), TEXT_BYTES):
                token, ends = shingle_sets(data, offsets, size)
                n = np.diff(ends)
                text = np.repeat(np.arange(len(n)), n)
                weight = np.zeros(len(token), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, token), len(common) - 1)
                    weight = np.where(common[at] == token, times[at], 0)
                rare = weight == 0
                rares = np.concatenate([[0], np.cumsum(rare)])
                place = rares[:-1] - rares[ends[text]]
                late = np.flatnonzero(~rare)
                order = late[np.lexsort((token[late], weight[late], text[late]))]
                lates = np.concatenate([[0], np.cumsum(~rare)])
                owner = text[order]
                place[order] = (rares[ends[owner + 1]] - rares[ends[owner]]) + np.arange(len(order)) - lates[ends[owner]]

                probe = n + -NUMERATOR * n // DENOMINATOR + 1  # the prefix that finds partners of this size or less
                index = n + -2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR) + 1  # ... that larger ones find
                need, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
                for matches in range(1, MOST_MATCHES + 1):
                    inside = place[order] < probe[owner] - 1 + matches
                    read = np.bincount(owner[inside], weight[order[inside]], minlength=len(n))
                    cost = read * (1 + VERIFY_COST / matches)
                    better = (cost < least) & (matches <= np.maximum(1, -(-NUMERATOR * n // DENOMINATOR)))
                    need[better], least[better] = matches, cost[better]
                reach = np.maximum(probe - 1 + need, index - 1 + MOST_MATCHES)
                inside = place < reach[text]
                text = text[inside]
                ids = b.column(0).take(pa.array(text + i))
                made = [token[inside].view(np.int64), n[text], place[inside], need[text]]
                yield pa.RecordBatch.from_arrays([pa.array(made[0]), ids, *[pa.array(x.astype(np.int32)) for x in made[1:]]], names)

    return run, "token long, id long, n int, place int, need int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop postings whose token no other row has; rows come ordered by token. The last row waits for the next batch."""
    held, before = None, None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        token = b.column(0).to_numpy()
        same = np.concatenate([[token[0] == before], token[1:] == token[:-1], [False]])
        yield b.slice(0, len(token) - 1).filter(pa.array((same[:-1] | same[1:])[:-1], pa.bool_()))
        held, before = b.slice(len(token) - 1), token[-2] if len(token) > 1 else before
    if held is not None and held.column(0)[0].as_py() == before:
        yield held


def _token_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1), TEXT_BYTES):
                token, ends = shingle_sets(data, offsets, size)
                sets = [token[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["id", "tokens"])

    return run, "id long, tokens binary"


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, n_a, n_c, bits_a, bits_c = (x.to_pylist() for x in b.columns)
        keep = [linked(most_overlap(*row), row[0], row[2]) for row in zip(n_a, bits_a, n_c, bits_c, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(size: int):
    """Rows (b, text of b, partners of b with their tokens): the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i, j, data, offsets in chunks(batch.column(1), TEXT_BYTES):
                token, ends = shingle_sets(data, offsets, size)
                for row, s, e in zip(range(i, j), ends[:-1], ends[1:], strict=True):
                    own = token[s:e]
                    other = np.frombuffer(batch.column(3)[row].as_buffer(), np.uint64)
                    overlap = len(np.intersect1d(own, other, assume_unique=True))
                    if linked(overlap, len(own), len(other)):
                        found.append((batch.column(2)[row].as_py(), batch.column(0)[row].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run, "a long, b long"


def _alike(n_a: str, n_b: str) -> str:
    """Sizes that do not rule a link out."""
    return f"{DENOMINATOR} * least({n_a}, {n_b}) >= {NUMERATOR} * greatest({n_a}, {n_b})"


def _links(texts: DataFrame, sizes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: bit maps rule most others out, whole sets decide."""
    left = sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    with_bits = pairs.join(left, "a").join(right, "b").where(_alike("n_a", "n_b")).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    close = store(with_bits.mapInArrow(_prune, "a long, b long"), "close")
    first = texts.join(close.select(F.col("a").alias("id")).distinct(), "id", "left_semi").mapInArrow(*_token_sets(size))
    carried = close.join(first.withColumnRenamed("id", "a"), "a")
    # Only the texts of pairs travel; where the pairs are few, Spark sends these to the texts instead.
    asked = texts.join(close.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    met = asked.join(carried.withColumnRenamed("b", "id"), "id").select("id", "text", "a", "tokens")
    return store(met.mapInArrow(*_verify(size)), "links")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) -> (node, root), the root being the smallest node that is reached."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((root(x), root(y)))
            above[high] = low
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def _components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have links: in one task while these are few, else in rounds over all tasks."""
    if links.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return links.select("a", "b").coalesce(1).mapInArrow(_union, "node long, root long")
    return connected_components(links)


def _joined(links: DataFrame) -> DataFrame:
    """(id, group) of what links join."""
    return store(_components(links), "groups").select(F.col("node").alias("id"), F.col("root").alias("group"))


def _strays(keys: DataFrame, star: DataFrame, turn: int) -> DataFrame:
    """(a, b): a document outside the largest star that shares a minimum with it, and some delegates of that star.

    `star` (id, star) names groups of documents that links join. Of the stars around it a document takes the one
    that it meets under most minima. Each `turn` has other delegates.
    """
    placed = keys.join(star, "id", "left").withColumn("star", F.coalesce("star", "id"))
    placed = store(placed, "minima")
    chosen = [F.min(F.struct(F.xxhash64("id", F.lit(turn * DELEGATES + i)), "id", "n")) for i in range(DELEGATES)]
    by_star = placed.groupBy("seed", "minimum", "star").agg(F.count(F.lit(1)).alias("members"), *[c.alias(f"d{i}") for i, c in enumerate(chosen)])
    delegates = F.array_distinct(F.array(*[F.struct(F.col(f"d{i}.id").alias("id"), F.col(f"d{i}.n").alias("n")) for i in range(DELEGATES)]))
    largest = by_star.groupBy("seed", "minimum").agg(
        F.max_by(F.struct("star", delegates.alias("delegates")), F.struct("members", "star")).alias("largest"), F.count(F.lit(1)).alias("stars")
    )
    largest = largest.where("stars > 1").select("seed", "minimum", "largest.star", "largest.delegates").withColumnRenamed("star", "near")
    met = placed.join(largest, ["seed", "minimum"]).where("star <> near")
    met = met.groupBy("id", "n", "near").agg(F.count(F.lit(1)).alias("seeds"), F.first("delegates").alias("delegates"))
    best = met.groupBy("id", "n").agg(F.max_by("delegates", F.struct("seeds", "near")).alias("delegates"))
    pairs = best.select("id", "n", F.explode("delegates").alias("d"))
    return pairs.where(_alike("n", "d.n")).select(F.col("d.id").alias("a"), F.col("id").alias("b"))


def _meeting(tokens: DataFrame) -> DataFrame:
    """Pairs of postings of a token, of documents in different groups that may link: the smaller set (s) and the larger (r)."""
    x = tokens.where("group <> largest").alias("x")
    y = tokens.alias("y")
    differ = " + ".join(f"bit_count(x.odd{i} ^ y.odd{i})" for i in range(SKETCH))
    small_first = "(x.n < y.n OR (x.n = y.n AND x.id < y.id))"
    # Only the first shared tokens matter, as many as are asked for. Before one of them fewer are shared, and after it no
    # more than either set has left: where that is too few, the pair does not link or has met often enough.
    fits = F.expr(
        f"""x.token = y.token AND x.group <> y.group AND (y.group = y.largest OR x.id < y.id)
        AND {_alike("x.n", "y.n")}
        AND {NUMERATOR + DENOMINATOR} * ({differ}) <= {DENOMINATOR - NUMERATOR} * (x.n + y.n)
        AND {NUMERATOR + DENOMINATOR} * (least(x.alive, y.alive, CASE WHEN {small_first} THEN y.need ELSE x.need END - 1)
        + least(x.n - x.place, y.n - y.place)) >= {NUMERATOR} * (x.n + y.n)"""
    )
    side = {c: [F.when(F.expr(small_first), F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}")) for s, t in (("x", "y"), ("y", "x"))] for c in ("id", "n", "place", "need")}
    return x.join(y, fits).select(
        *[v[0].alias(f"{c}_s") for c, v in side.items()], *[v[1].alias(f"{c}_r") for c, v in side.items()]
    )


def jaccard_groups(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest id with the same set), component_id.

    Two documents link when the Jaccard similarity of their sets of word shingles is 3/4 or more; a component is what
    links reach. Equal sets are one class. The result is components, not links: links between different sets within
    one component of step 1 are neither listed nor counted. Three steps find all links that join components:

    1. Every class is paired with the smallest id that shares one of six minima. What does not link with the largest
       of the groups around it is paired with four more of its members, those of the one group that it meets most,
       and this up to three times. The pairs that link join dense groups of near copies without listing their pairs; any pair may be left out here,
       as step 2 finds all links between groups.
    2. Prefixes: tokens are ordered rare first; tasks count the tokens of all texts, and the most frequent ones, a
       bounded number, are known to all. The order is the same for all and any order is right. A prefix is
       lengthened to that number of matches, up to four, for which reading its postings and verifying the candidates
       is estimated to cost least; a candidate must share as many prefix tokens, and its places of the last shared
       one must leave room for enough others, and
       sketches of both sets must not differ in more bits than the sets may in tokens. Only documents of different
       components of step 1 meet, and a token's largest component meets the others but not itself.
    3. Candidates are ruled out by bit maps where these prove too little overlap, and verified on whole sets.

    Defined cases: a NULL text or a text without words has no set, links with nothing and is its own component. NULL
    ids have component NULL and link with nothing. Rows that repeat an id are one document for links. Empty tables
    give no rows; other columns are ignored. Tokens are 64-bit hashes of shingles.
    """
    with batch_bytes(df.sparkSession, BATCH_BYTES), reader_rows(df.sparkSession, READ_ROWS):
        return _grouped(df, size, id_col, text_col, most_common)


def _grouped(df: DataFrame, size: int, id_col: str, text_col: str, most_common: int) -> DataFrame:
    rows = df.select(integral(df, id_col).alias("id"), df[text_col].cast("string").alias("text"))
    profiled = store(rows.mapInArrow(*_profiles(size)), "profiles")
    documents = profiled.where("kind = 0")
    classes = store(
        documents.where("n > 0 AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("bits").alias("bits"), F.first("odd").alias("odd")),
        "classes",
    )
    texts = rows.where("id IS NOT NULL")

    # Step 1.
    keys = classes.select("id", "n", F.posexplode("minima").alias("seed", "minimum"))
    centres = keys.groupBy("seed", "minimum").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("met")).where("met > 1")
    centres = centres.select("seed", "minimum", F.col("c.id").alias("a"), F.col("c.n").alias("n_a"))
    stars = keys.join(centres, ["seed", "minimum"]).where("id <> a").where(_alike("n", "n_a")).select("a", F.col("id").alias("b")).distinct()
    star_links = _links(texts, classes, stars, size)
    joined = _joined(star_links)
    for turn in range(STRAY_TURNS):
        more = _links(texts, classes, _strays(keys, joined.withColumnRenamed("group", "star"), turn), size)
        if more.isEmpty():
            break
        star_links = star_links.unionByName(more)
        joined = _joined(star_links)
    of_class = classes.select("id").join(joined, "id", "left").select("id", F.coalesce("group", "id").alias("group"))

    # Step 2.
    counted = profiled.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COMMON)
    counted = store(counted, "common")
    above = F.sum("tokens").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    # One row for each number of texts.
    cut = counted.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).withColumn("above", above).where(F.col("above") <= most_common)
    least = cut.agg(F.min("n")).first()[0]
    table = counted.where(F.col("n") >= (2**62 if least is None else least)).select("id", "n").toArrow()
    common, times = table["id"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(common)
    postings = texts.mapInArrow(*_postings(size, common[order], times[order]))
    met = postings.repartition("token").sortWithinPartitions("token").mapInArrow(_met, postings.schema)
    met = store(met.join(of_class, "id").distinct(), "postings")
    held = met.groupBy("token", "group").agg(F.count(F.lit(1)).alias("rows"))
    largest = held.groupBy("token").agg(F.max_by("group", F.struct("rows", "group")).alias("largest"), F.count(F.lit(1)).alias("groups"))
    tokens = met.join(largest.where("groups > 1").drop("groups"), "token")
    # Tokens that nobody in another group has are gone, so `alive` bounds what may be shared before a place. Too many
    # that are gone leave a document too few for any partner.
    alive = F.row_number().over(W.partitionBy("id").orderBy("place")) - 1
    tokens = tokens.withColumn("alive", alive).where(f"{DENOMINATOR} * (alive + n - place) >= {NUMERATOR} * n")
    sketches = classes.select("id", *[F.col("odd")[i].alias(f"odd{i}") for i in range(SKETCH)])
    tokens = store(tokens.join(sketches, "id"), "tokens")
    pairs = _meeting(tokens)
    probe = f"n_r - ceil({NUMERATOR} * n_r / {DENOMINATOR}) + need_r"
    index = f"n_s - ceil({2 * NUMERATOR} * n_s / {NUMERATOR + DENOMINATOR}) + need_r"
    pairs = pairs.where(f"place_r < {probe} AND place_s < {index}").groupBy(
        F.col("id_s").alias("a"), F.col("id_r").alias("b"), "n_s", "n_r"
    ).agg(F.count(F.lit(1)).alias("matches"), F.max("need_r").alias("need"), F.max("place_s").alias("last_s"), F.max("place_r").alias("last_r"))
    # All shared tokens up to the last match have been counted; after it there are at most as many as either has left.
    enough = f"{NUMERATOR + DENOMINATOR} * (matches + least(n_s - last_s, n_r - last_r) - 1) >= {NUMERATOR} * (n_s + n_r)"
    pairs = pairs.where(f"matches >= need AND {enough}").select("a", "b")
    # Step 3.
    cross = _links(texts, classes, pairs, size)
    of_group = joined.withColumnRenamed("group", "root")
    ends = [F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c) for c in ("a", "b")]
    for c in ("a", "b"):
        cross = cross.join(of_group.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    between = store(cross.select(*ends).where("a <> b").distinct(), "between")
    merged = _components(between).select(F.col("node").alias("group"), F.col("root").alias("merged"))
    components = of_class.join(merged, "group", "left").select(F.col("id").alias("class_id"), F.coalesce("merged", "group").alias("root"))
    class_of = classes.select(F.col("digest").alias("of"), F.col("id").alias("class_id"))
    out = documents.select("id", "n", "digest").join(class_of, (F.col("digest") == F.col("of")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    out = out.join(components, "class_id", "left")
    class_id = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), class_id.alias("class_id"), F.coalesce("root", class_id).alias("component_id")
    )
