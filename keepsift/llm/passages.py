"""Passages of at least k words that occur more than once: what substring dedup and suffix-array dedup share.

A window is k consecutive words of one text. Every window belongs to the leftmost smallest hash among its first w
word m-grams, its anchor; equal windows have equal anchors. Consecutive windows with the same key (made from the
anchor) form a run. Four steps follow:

1. every run reports its key; keys are counted over all texts, and runs whose key occurs once are done: none of
   their windows occurs elsewhere;
2. the other runs are cut from their texts, as one string each;
3. strings meet in the bucket of their key, where they are compared (windows by substring dedup, suffixes by
   suffix-array dedup);
4. covered words come back to their texts as intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral, same
from keepsift.llm.words import Words, chunks, ngrams, sliding_min
from keepsift.session import store

#: Strings of one key that a bucket compares in memory, and words in them; keys with more compare window by window
#: (same result).
HOT_RUNS, HOT_WORDS = 50_000, 4_000_000
#: Bytes of strings compared at once.
AT_ONCE = 1_000_000
_PLACE = np.uint64(0xFFFFFFFF)
ID = ["doc_id", "mark"]


@dataclass(frozen=True)
class Shape:
    """Windows of `k` words, anchors among their first `w` m-grams of `m` words, keys from `key` words at the anchor."""

    k: int
    m: int
    w: int
    key: int


def find_runs(words: Words, shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, start, windows, lead, key, several) of each run; lead: words before the anchor of its first window;
    several: its windows have more than one anchor, so it may hold the same window twice."""
    none = tuple(np.zeros(0, t) for t in (int, int, int, int, np.uint64, bool))
    if len(words) < shape.k:
        return none
    hashes = words.hashes()
    small = ngrams(hashes, shape.m)
    order = (small & ~_PLACE) | np.arange(len(small), dtype=np.uint64)
    anchors = (sliding_min(order, shape.w) & _PLACE).astype(np.int64)
    at = np.flatnonzero(np.arange(len(words)) + shape.k <= words.high[words.text])
    if not len(at):
        return none
    text, anchors = words.text[at], anchors[at]
    keys = (small if shape.key == shape.m else ngrams(hashes, shape.key))[anchors]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(text) != 0) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    last = first + size - 1
    return text[first], at[first] - words.low[text[first]], size, anchors[first] - at[first], keys[first], anchors[first] != anchors[last]


def _report(shape: Shape):
    names = [*ID, "key", "start", "windows", "lead", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2)):
                text, start, windows, lead, key, several = find_runs(Words(data, offsets), shape)
                if len(text):
                    take = pa.array(text + i)
                    made = [key.view(np.int64), start, windows, lead, 1 + several.astype(int)]
                    columns = [b.column(0).take(take), b.column(1).take(take), *[pa.array(x.astype(np.int64)) for x in made]]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run, "doc_id long, mark long, key long, start long, windows long, lead long, weight long"


def _cut(k: int):
    names = [*ID, "key", "start", "hot", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc_id, mark, text, runs = (b.column(c)[row].as_py() for c in range(4))
                words = (text or "").encode().split()
                made = [[] for _ in names]
                for r in runs:
                    s, p = r["start"], r["start"] + r["lead"]
                    head, tail = words[s:p], words[p : s + r["windows"] - 1 + k]
                    for column, value in zip(made, (doc_id, mark, r["key"], s, r["hot"], b" ".join(head), b" ".join(tail)), strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names)

    return run, "doc_id long, mark long, key long, start long, hot boolean, head binary, tail binary"


def joined(head: bytes, tail: bytes) -> bytes:
    return head + b" " + tail if head else tail


Row = tuple[int, int, int, bytes, bytes]
Spans = list[list[tuple[int, int]]]


def laid_out(strings: list[bytes]) -> tuple[bytes, Words]:
    """The strings one after another, and their words."""
    sizes = np.array([len(s) for s in strings], np.int64) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    offsets[-1] -= 1
    buffer = b"\n".join(strings)
    return buffer, Words(np.frombuffer(buffer, np.uint8), offsets)


def spans_of(words: Words, hit: np.ndarray, k: int, n: int) -> Spans:
    """For each of n strings, the word intervals that windows of k words cover which begin at the words `hit`."""
    found: Spans = [[] for _ in range(n)]
    if not len(hit):
        return found
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(words.text[hit]) != 0)]))
    ends = np.append(cut[1:], len(hit)) - 1
    for a, e in zip(hit[cut], hit[ends], strict=True):
        t = words.text[a]
        found[t].append((int(a - words.low[t]), int(e - words.low[t] + k)))
    return found


def repeated(rows: list[Row], k: int) -> Spans:
    """For each string, the word intervals that are covered by windows which occur more than once among all strings.

    Windows are sorted by hash; equal hashes are compared by their words. No strings: no intervals.
    """
    if not rows:
        return []
    buffer, words = laid_out([joined(r[3], r[4]) for r in rows])
    if len(words) < k:
        return [[] for _ in rows]
    at = np.flatnonzero(np.arange(len(words)) + k <= words.high[words.text])
    hashes = ngrams(words.hashes(), k)[at]
    order = np.argsort(hashes, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0, [True]]))
    twice = np.zeros(len(at), bool)
    for a, e in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):
        by_words: dict[bytes, list[int]] = {}
        for i in order[a:e]:
            by_words.setdefault(buffer[words.starts[at[i]] : words.ends[at[i] + k - 1]], []).append(i)
        for same_words in by_words.values():
            if len(same_words) > 1:
                twice[same_words] = True
    return spans_of(words, at[twice], k, len(rows))


def _meet(compared: Callable[[list[Row]], Spans]):
    """Compare the strings of a bucket; rows come ordered by key and string, so equal strings follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[Row] = []  # one for each different string of whole keys
        size = 0
        key, last, emitted = None, None, False

        def covered(row):
            out.append((row[0], row[1], row[2], row[2] + joined(row[3], row[4]).count(b" ") + 1))

        def compare():
            nonlocal held, size
            for r, spans in zip(held, compared(held), strict=True):
                out.extend((r[0], r[1], r[2] + s, r[2] + e) for s, e in spans)
            held, size = [], 0

        def batch():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*ID, "begin", "end"])

        for b in batches:
            for doc_id, mark, new, start, head, tail in zip(*[c.to_pylist() for c in b.columns], strict=True):
                row = (doc_id, mark, start, head, tail)
                if new != key:
                    if size > AT_ONCE:
                        compare()
                    key, last = new, None
                if last is not None and last[3] == head and last[4] == tail:
                    # Every window of a string that came before occurs twice.
                    if not emitted:
                        covered(last)
                        emitted = True
                    covered(row)
                else:
                    held.append(row)
                    size += len(head) + len(tail)
                    last, emitted = row, False
                if len(out) >= 10_000:
                    yield batch()
        compare()
        if out:
            yield batch()

    return run, "doc_id long, mark long, begin long, end long"


def _windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, mark, start, head, tail in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = joined(head, tail).split(b" ")
                n = len(words) - k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([mark] * n, pa.int64()),
                        pa.array(range(start, start + n), pa.int64()),
                        pa.array([b" ".join(words[i : i + k]) for i in range(n)], pa.binary()),
                    ],
                    [*ID, "begin", "window"],
                )

    return run, "doc_id long, mark long, begin long, window binary"


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): the mark is a hash of the text, so rows that share an id or have none stay apart."""
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(integral(df, id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def covered_words(texts: DataFrame, shape: Shape, compared: Callable[[list[Row]], Spans], hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, mark, begin, end): word intervals of every text that are covered by repeated windows.

    `compared` gives the intervals of the strings of whole keys, all of which it gets at once.
    """
    reported = store(texts.mapInArrow(*_report(shape)), "runs")
    words = F.sum(F.col("windows") + shape.k - 1)
    counts = reported.groupBy("key").agg(
        F.sum("weight").alias("weight"), ((F.count(F.lit(1)) > hot_runs) | (words > HOT_WORDS)).alias("hot")
    )
    shared = reported.join(counts.where("weight > 1"), "key")
    # Runs of one text: no more than it has words.
    by_text = shared.groupBy(*ID).agg(F.collect_set(F.struct("key", "start", "windows", "lead", "hot")).alias("runs"))
    by_text = by_text.hint("shuffle_hash")
    met = texts.join(by_text, same(texts, by_text, *ID)).select(*[texts[c] for c in texts.columns], "runs")
    strings = met.mapInArrow(*_cut(shape.k))

    dealt = strings.where("NOT hot").select(*ID, "key", "start", "head", "tail").repartition("key").sortWithinPartitions("key", "tail", "head")
    intervals = dealt.mapInArrow(*_meet(compared))
    if counts.where("weight > 1 AND hot").isEmpty():
        return intervals
    windows = strings.where("hot").select(*ID, "start", "head", "tail").mapInArrow(*_windows(shape.k))
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return intervals.unionByName(
        windows.join(twice, "window").select(*ID, "begin", (F.col("begin") + shape.k).alias("end"))
    )


def _remove():
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, intervals in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                spans: list[list[int]] = []
                for r in sorted(intervals or (), key=lambda r: r["begin"]):
                    if spans and r["begin"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["end"])
                    else:
                        spans.append([r["begin"], r["end"]])
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept = kept + words[at:] if spans else words
                sha = hashlib.sha256(b" ".join(kept)).hexdigest()
                rows.append((doc_id, len(words), len(words) - len(kept), sha, [{"start": s, "end": e} for s, e in spans]))
            kinds = [pa.int64()] * 3 + [pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def without(texts: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row per text: doc_id, n_words, n_removed, kept_sha256 and the spans of words that `intervals` cover."""
    by_text = intervals.groupBy(*ID).agg(F.collect_set(F.struct("begin", "end")).alias("intervals")).hint("shuffle_hash")
    met = texts.join(by_text, same(texts, by_text, *ID), "left")
    return met.select(texts["doc_id"], texts["text"], "intervals").mapInArrow(*_remove())
