"""Byte-level BPE encoding and decoding; merges find their next pair in a segment tree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral
from keepsift.llm.words import chunks

#: Pieces longer than this are merged one by one, shorter ones many at a time.
TOGETHER = 64
#: Pieces whose ids a worker remembers.
REMEMBERED = 200_000
#: No pair: above every rank. A key of the tree is rank << 32 | place, so that ties go to the left.
_NONE = np.int64(1) << 62


class Ranks:
    """Ranks of byte strings: a pair of tokens merges at the rank of its joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        # Open addressing: a pair's place is its hash, or the next free one.
        self._shift = np.uint64(64 - max(8, (2 * len(pairs)).bit_length() + 1))
        self._pairs = np.full(1 << (64 - int(self._shift)), -1, np.int64)
        self._ranks = np.zeros(len(self._pairs), np.int64)
        left = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slots(left)
        while len(left):
            free = np.flatnonzero(self._pairs[at] < 0)
            self._pairs[at[free]] = left[free]  # of several at one place the last stays
            placed = self._pairs[at] == left
            self._ranks[at[placed]] = value[placed]
            left, value, at = left[~placed], value[~placed], (at[~placed] + 1) & (len(self._pairs) - 1)
        self._starts = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self._all = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        #: The number of every piece that is remembered; the ids of all pieces one after another, and where each ends.
        self._known: dict[str, int] = {}
        self._ids, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _keys_of(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree keys of neighbouring tokens; -1 stands for no token."""
        pair = np.where((left >= 0) & (right >= 0), (left << 32) | right, -2)
        at = self._slots(pair)
        found = self._pairs[at]
        out = np.where(found == pair, (self._ranks[at] << 32) | place, _NONE)
        on = np.flatnonzero((found != pair) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self._pairs) - 1)
            found = self._pairs[at[on]]
            hit = found == pair[on]
            out[on[hit]] = (self._ranks[at[on[hit]]] << 32) | place[on[hit]]
            on = on[~hit & (found >= 0)]
        return out

    def merge_many(self, pieces: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces of at most `wide` bytes, a power of two.

        Every piece has a segment tree of its own; all are stepped together."""
        n, row = len(pieces), wide + 1  # the last column of a row stands for "no neighbour"
        sizes = np.array([len(p) for p in pieces])
        there = np.arange(wide) < sizes[:, None]
        filled = np.zeros((n, wide), np.uint8)
        filled[there] = np.frombuffer(b"".join(pieces), np.uint8)
        token = np.full((n, row), -1, np.int64)
        token[:, :wide] = np.where(there, self.byte_ids[filled], -1)
        place = np.broadcast_to(np.arange(wide), (n, wide))
        after = np.full((n, row), wide)
        after[:, :wide] = np.where(place + 1 < sizes[:, None], place + 1, wide)
        before = np.full((n, row), wide)
        before[:, 1:] = place
        tree = np.full((n, 2 * wide), _NONE)
        tree[:, wide:] = self._keys_of(token[:, :wide].ravel(), token[:, 1:].ravel(), place.ravel()).reshape(n, wide)
        for level in range(wide - 1, 0, -1):
            np.minimum(tree[:, 2 * level], tree[:, 2 * level + 1], out=tree[:, level])
        live = np.zeros((n, row), bool)
        live[:, :wide] = there
        tokens, afters, befores, lives, nodes = token.ravel(), after.ravel(), before.ravel(), live.ravel(), tree.ravel()

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            base, root = rows * row, rows * (2 * wide)
            best = nodes[root + 1]
            at = best & 0xFFFFFFFF
            gone = afters[base + at]
            follow, lead = afters[base + gone], befores[base + at]
            tokens[base + at] = best >> 32
            lives[base + gone] = False
            afters[base + at] = follow
            befores[base + follow] = at
            # Three leaves change: the swallowed token's, the pair's and, where there is one, the left neighbour's.
            some = np.flatnonzero(lead < wide)
            left = np.concatenate([at, lead[some]])
            right = np.concatenate([follow, at[some]])
            under = np.concatenate([base, base[some]])
            keys = self._keys_of(tokens[under + left], tokens[under + right], left)
            leaf = np.concatenate([gone, left]) + wide
            over = np.concatenate([root, root, root[some]])
            nodes[over[: len(rows)] + leaf[: len(rows)]] = _NONE
            nodes[over[len(rows) :] + leaf[len(rows) :]] = keys
            for _ in range(wide.bit_length() - 1):
                leaf >>= 1
                below = over + 2 * leaf
                nodes[over + leaf] = np.minimum(nodes[below], nodes[below + 1])
            rows = rows[nodes[root + 1] < _NONE]
        return token[live].astype(np.int32), live.sum(1)

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same for one piece of any length: every merge costs three updates of logarithmic length."""
        n = len(piece)
        wide = 1 << max(1, (n - 1).bit_length())
        none, last, shift = int(_NONE), len(self._pairs) - 1, int(self._shift)
        token = [int(self.byte_ids[b]) for b in piece]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [none] * (2 * wide)

        def key(i: int) -> int:
            j = after[i]
            if j < 0:
                return none
            pair = token[i] << 32 | token[j]
            at = (pair * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
            while (found := int(self._pairs[at])) >= 0:
                if found == pair:
                    return int(self._ranks[at]) << 32 | i
                at = (at + 1) & last
            return none

        for i in range(n):
            tree[wide + i] = key(i)
        for node in range(wide - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, value: int) -> None:
            node = leaf + wide
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a <= b else b

        while tree[1] != none:
            rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = after[at]
            token[at], after[at] = rank, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = at
            update(gone, none)
            update(at, key(at))
            if before[at] >= 0:
                update(before[at], key(before[at]))
        out, i = [], 0
        while i >= 0 and n:
            out.append(token[i])
            i = after[i]
        return tuple(out)

    def _learn(self, pieces: set[str]) -> None:
        """Find the ids of pieces, each on its own; a piece that is a token stays whole."""
        fresh = [p for p in pieces if p not in self._known]
        if len(self._known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = list(pieces)
        names: list[str] = []
        ids, sizes = [self._ids], []
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in fresh:
            b = p.encode()
            whole = self.ids.get(b)
            if whole is None and len(b) <= TOGETHER:
                group = groups.setdefault(1 << max(1, (len(b) - 1).bit_length()), ([], []))
                group[0].append(p)
                group[1].append(b)
            else:
                own = [whole] if whole is not None else self.merge_one(b)
                names.append(p)
                ids.append(np.array(own, np.int32))
                sizes.append(np.array([len(own)]))
        for wide, (some, data) in groups.items():
            step = max(1, 100_000 // wide)
            for i in range(0, len(some), step):
                got = self.merge_many(data[i : i + step], wide)
                ids.append(got[0])
                sizes.append(got[1])
            names += some
        if names:
            base = len(self._known)
            self._known.update(zip(names, range(base, base + len(names)), strict=True))
            self._ids = np.concatenate(ids)
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str], pattern) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        found = [pattern.findall(t) for t in texts]
        self._learn(set().union(*found))
        count = np.array([len(f) for f in found])
        at = np.fromiter(map(self._known.__getitem__, chain.from_iterable(found)), np.int64, int(count.sum()))
        sizes = self._ends[at + 1] - self._ends[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(self._ends[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(count)])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and where each id's bytes end."""
        sizes = self._starts[ids + 1] - self._starts[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self._starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._all[source], ends


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(2)
def compiled(pattern: str):
    return regex.compile(pattern)


def _encoding(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = ranks(path), compiled(pattern)
        for b in batches:
            for i, j, _, _ in chunks(b.column(1)):
                ids, ends = table.encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()], split)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return run


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for b in batches:
            lists = b.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = table.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            offsets = np.concatenate([[0], at])[ends].astype(np.int64)
            buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, buffers)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(integral(df, id_col).alias("doc_id"), df[text_col].cast("string").alias("text"))


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>) of the whole text.

    `pattern` cuts the text into pieces; each is encoded by itself by the ranks in the file `path`, which every
    executor has. A segment tree over a piece's byte positions holds the leftmost pair of lowest rank; a merge
    changes three leaves: the pair's own, the swallowed token's and the left neighbour's. No special tokens.
    Short pieces are merged many at a time, one tree each, and a worker remembers a bounded number of pieces.

    Defined cases: a NULL text is empty and has no ids; NULL ids and repeated rows stay as they are; an empty table
    gives no rows; other columns are ignored.
    """
    return _texts(df, id_col, text_col).mapInArrow(_encoding(path, pattern), "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, ids, decoded (binary): the bytes that the ids stand for. NULL ids are no ids."""
    ids = F.coalesce(df[ids_col].cast("array<int>"), F.array().cast("array<int>"))
    rows = df.select(integral(df, id_col).alias("doc_id"), ids.alias("ids"))
    return rows.mapInArrow(_decoding(path), "doc_id long, ids array<int>, decoded binary")


def bpe_round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode followed by bpe_decode in the same workers, so a task needs one worker and not two."""
    encode, decode = _encoding(path, pattern), _decoding(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decode(encode(batches))

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
