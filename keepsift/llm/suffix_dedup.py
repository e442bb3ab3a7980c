"""Suffix-array dedup with sparse suffix arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from keepsift.llm.passages import HOT_RUNS, Row, Shape, Spans, covered_words, joined, laid_out, spans_of, texts_of, without
from keepsift.llm.words import Words

#: Words of the shortest passage that counts; of the n-grams that select positions; sure to follow a selected position.
PASSAGE, SELECT, SUFFIX = 50, 5, 20


def word_ids(buffer: bytes, words: Words) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    raw = [buffer[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in raw], np.int64)


def ranks(ids: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The order of the word sequences of `length` words from each place on, by prefix doubling.

    A sequence stops at `ends` (exclusive) of its place; equal sequences have equal ranks.
    """
    place = np.arange(len(ids))
    rank, width = ids + 1, 1

    def both(step: int) -> np.ndarray:
        after = np.where(place + step < ends, rank[np.minimum(place + step, len(ids) - 1)], 0)
        return np.unique(rank * (len(ids) + 2) + after, return_inverse=True)[1] + 1

    while width * 2 <= length:
        rank, width = both(width), width * 2
    return both(length - width) if width < length else rank


def common(ids: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many words in a row, `most` at most, are equal from the places a and b on."""
    size, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    for step in range(most):
        x, y = a[todo] + step, b[todo] + step
        inside = (x < ends[a[todo]]) & (y < ends[b[todo]])
        last = len(ids) - 1
        todo = todo[inside & (ids[np.minimum(x, last)] == ids[np.minimum(y, last)])]
        if not len(todo):
            break
        size[todo] = step + 1
    return size


def extended(rows: list[Row], k: int, suffix: int) -> Spans:
    """For each string (head, tail), the word intervals of passages of k words or more that occur more than once.

    A retained suffix begins with the tail's first `suffix` words, wherever they stand in the string. Suffixes are
    sorted and each compared with its neighbour: the words they share to the right. The same is done with what stands
    before them, sorted from the suffix to the left. Neighbours that share r words or more on a side form a run, and any two of a run do.
    So a match that reaches n words to the left and k - n to the right is two suffixes in one run on both sides; it is
    read off the runs for every n, without looking at pairs.
    """
    if not rows:
        return []
    buffer, words = laid_out([joined(r[3], r[4]) for r in rows])
    if len(words) < k:
        return [[] for _ in rows]
    ids, low, high = word_ids(buffer, words), words.low[words.text], words.high[words.text]
    first = words.low + np.array([r[3].count(b" ") + 1 if r[3] else 0 for r in rows])
    anchor = first[words.text]
    at = np.flatnonzero((np.arange(len(ids)) >= anchor) & (np.arange(len(ids)) + suffix <= high))
    for step in range(suffix):
        at = at[ids[at + step] == ids[anchor[at] + step]]
    if len(at) < 2:
        return [[] for _ in rows]

    left = k - suffix
    order = np.argsort(ranks(ids, high, k)[at], kind="stable")
    right_shared = common(ids, high, at[order[:-1]], at[order[1:]], k)
    # Reversed, what stands before a place goes on from it; the place itself is left out.
    back, back_ends = ids[::-1], len(ids) - low[::-1]
    before = len(ids) - at  # place, in the reversed words, of the word before; one too many where none is left
    none = at == low[at]
    before_rank = np.where(none, 0, ranks(back, back_ends, left)[np.minimum(before, len(ids) - 1)]) if left else np.zeros(len(at), np.int64)
    mirrored = np.argsort(before_rank, kind="stable")
    a, b = (np.minimum(before[m], len(ids) - 1) for m in (mirrored[:-1], mirrored[1:]))
    left_shared = np.where(none[mirrored[:-1]] | none[mirrored[1:]], 0, common(back, back_ends, a, b, left))

    twice = np.zeros(len(ids), bool)
    right_run, left_run = (np.zeros(len(at), np.int64) for _ in range(2))
    for n in range(left + 1):
        right_run[order] = np.concatenate([[0], np.cumsum(right_shared < k - n)])
        left_run[mirrored] = np.concatenate([[0], np.cumsum(left_shared < n)])
        fits = np.flatnonzero((at - n >= low[at]) & (at - n + k <= high[at]))
        run, of, times = np.unique(right_run[fits] * len(at) + left_run[fits], return_inverse=True, return_counts=True)
        twice[at[fits[times[of] > 1]] - n] = True
    return spans_of(words, np.flatnonzero(twice), k, len(rows))


def suffix_dedup(
    df: DataFrame,
    passage: int = PASSAGE,
    select: int = SELECT,
    suffix: int = SUFFIX,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans of words.

    Removed are all words of passages of `passage` or more words that occur more than once, in one text or several.
    The suffix array is sparse: of the words among which a passage must begin to match, only the position with the
    smallest hash of `select` words is retained, the same one in every copy, and a passage has at least `suffix` words
    from there on. Suffixes are dealt by their first words to buckets, sorted there and compared with their neighbours,
    and matches are extended to the left and to the right (`extended`); a suffix carries its passages' text on both
    sides, so this needs no look-up. Suffixes whose first words occur once in all texts are left out before any text
    moves; where more than `hot_runs` share them (or HOT_WORDS words stand in them), windows of `passage` words are
    counted over all tasks, with the same result.

    Defined cases: as for substring_dedup. Words are separated by space and 09-0D only; a NULL text has none; rows
    that repeat an id or have none are texts of their own. Empty tables give no rows; other columns are ignored.
    """
    texts = texts_of(df, id_col, text_col)
    shape = Shape(passage, select, passage - suffix + 1, suffix)
    return without(texts, covered_words(texts, shape, lambda rows: extended(rows, passage, suffix), hot_runs))
