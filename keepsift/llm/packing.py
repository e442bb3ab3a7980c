"""Best-fit packing of tokenised documents into sequences, online with a bounded number of open bins."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.llm import bpe
from keepsift.llm.common import integral
from keepsift.session import store

LENGTH, END_ID = 1024, 2
#: Bins that are open at once, and pieces that one task packs (about: they are dealt by hash).
OPEN_BINS, TASK_PIECES = 1024, 50_000
#: Fixed value: the special token of the vocabulary; its string in a text stands for the token.
SPECIAL = "<|endoftext|>"


@lru_cache(2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file; its ids are those of the tokenizer file made from the same vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _plain_ids(text: str, path: str, pattern: str) -> np.ndarray:
    try:
        return encoder(path, pattern).encode_to_numpy(text, disallowed_special=())
    except ValueError:  # its regular expressions give up on very long runs of white space
        return bpe.ranks(path).encode([text], bpe.compiled(pattern))[0].astype(np.uint32)


def token_ids(text: str, path: str, pattern: str, special: str = SPECIAL) -> np.ndarray:
    """Ids as the vocabulary's own tokenizer gives them, the special token's string included."""
    found: list[np.ndarray] = []
    for part in text.split(special):
        found += [_plain_ids(part, path, pattern), np.array([encoder(path, pattern).n_vocab], np.uint32)]
    return np.concatenate(found[:-1])


class OpenBins:
    """At most `most` open bins. A bitset over free space has a bit for every free space that an open bin has."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the fullest open bin that it fits, or a new one."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_id, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.length - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got


def pieces(df: DataFrame, path: str, pattern: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut where they are too long, the first piece the shorter one."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path, pattern), end_id).astype("<u4")
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc_id, i, s, e - s, zlib.crc32(ids[s:e].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = df.select(integral(df, id_col).alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(
    df: DataFrame,
    path: str,
    pattern: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    task_pieces: int = TASK_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`. Longer ones than `length` are cut, all pieces but the first of full length.
    Pieces are dealt by hash to tasks of about `task_pieces` and packed online: each goes into the fullest open bin
    that has room; when `open_bins` are open and a new one is needed, the fullest closes. The order within a task is
    fixed, so a repeated task packs alike. Full pieces make a sequence each.

    Defined cases: a NULL text is empty, its document is the end id alone. NULL ids and rows that repeat an id are
    documents of their own; of equal pieces any may come first. An empty table gives no rows; other columns are ignored.
    """
    cut = store(pieces(df, path, pattern, length, end_id, id_col, text_col), "pieces")
    tasks = max(1, -(-cut.count() // task_pieces))
    dealt = cut.withColumn("dealt", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = dealt.repartition(tasks, "dealt").sortWithinPartitions("dealt", "doc_id", "piece").drop("dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.place(n) for n in b.column(3).to_pylist()]
            ids, offsets = (pa.array([x[c] + base * (c == 0) for x in placed], pa.int64()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, offsets], [*b.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
