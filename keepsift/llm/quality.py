"""Quality classifier: ordinal cumulative-link regression on graded ratings of hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsift.llm.common import integral
from keepsift.llm.words import Words, chunks, mixed

#: Bytes of text turned into features at once: the arrays for it take many times as much.
TEXT_BYTES = 250_000
#: Labelled rows that a fit reads at most: those with the smallest hash of their id.
SAMPLE = 8000
#: Labelled rows a feature has to occur in.
LEAST_ROWS = 40
FEATURE_BITS = 32

#: Letters, digits and all bytes beyond ASCII make words here; A-Z fold.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = ~_WORD & ~_SPACE
#: Levels of each count and share.
SHARES = 10


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: hashed words and hashed runs of symbols of the whole text, and its shape.

    The shape counts words that repeat the word before them and runs of over two symbols, in powers of two, and the
    shares of repeating words and of symbol runs, in tenths. A level that is reached is a feature, as are all below.
    """
    n = len(offsets) - 1
    data = _FOLD[data]
    words = Words(data, offsets, _WORD)
    hashes = words.hashes()
    count = np.maximum(np.bincount(words.text, minlength=n), 1)

    symbols = Words(data, offsets, _SYMBOL)
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    of_text = np.concatenate([words.text, symbols.text]).astype(np.uint64)
    runs = np.concatenate([hashes, mixed(symbols.hashes())]) >> np.uint64(64 - FEATURE_BITS)
    keys = np.unique((of_text << np.uint64(FEATURE_BITS)) | runs)
    text, found = [(keys >> np.uint64(FEATURE_BITS)).astype(np.int64)], [keys & np.uint64((1 << FEATURE_BITS) - 1)]
    long_symbols = np.bincount(symbols.text, (symbols.ends - symbols.starts) > 2, minlength=n)
    shapes = [
        *(np.log2(1 + np.bincount(words.text, again, minlength=n)), np.log2(1 + long_symbols)),
        np.bincount(words.text, again, minlength=n) / count * SHARES,
        np.bincount(symbols.text, minlength=n) / count * SHARES,
    ]
    for kind, values in enumerate(shapes):
        for level in range(1, SHARES + 1):
            at = np.flatnonzero(values >= level)
            name = mixed(np.array([(kind + 1) << 32 | level], np.uint64)) >> np.uint64(64 - FEATURE_BITS)
            text.append(at)
            found.append(np.repeat(name, len(at)))
    return np.concatenate(text), np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Grades 0 to len(thresholds); P(grade <= j) = sigmoid(thresholds[j] - score), one weight per feature for all grades."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature = features(data, offsets)
        if not len(self.known):
            return np.zeros(len(offsets) - 1)
        at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        hit = self.known[at] == feature
        return np.bincount(text[hit], self.weights[at[hit]], minlength=len(offsets) - 1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1 to the highest grade, one row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit_ordinal(
    row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, epochs: int = 12, rate: float = 1.0, sparsity: float = 1e-3, seed: int = 7
) -> Model:
    """Weights by adaptive gradient steps with an L1 penalty; thresholds stay ordered as a first one plus positive gaps."""
    known, column, rows_with = np.unique(feature, return_inverse=True, return_counts=True)
    often = rows_with >= min(LEAST_ROWS, max(2, len(grade) // 100))
    keep = often[column]
    place = np.cumsum(often) - 1
    known, row, column = known[often], row[keep], place[column[keep]]
    order = np.argsort(row, kind="stable")
    row, column = row[order], column[order]
    begin = np.searchsorted(row, np.arange(len(grade) + 1))

    upto = np.array([np.clip((grade <= j).mean(), 0.01, 0.99) for j in range(grades - 1)])
    start = np.log(upto / (1 - upto))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    w, seen, seen_t = np.zeros(len(known)), np.full(len(known), 1e-8), np.full(len(theta), 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        dealt = random.permutation(len(grade))
        for b in range(0, len(dealt), 64):
            part = dealt[b : b + 64]
            sizes = begin[part + 1] - begin[part]
            ends = np.cumsum(sizes)
            if not len(ends) or not ends[-1]:
                continue
            columns = column[np.repeat(begin[part] - (ends - sizes), sizes) + np.arange(ends[-1])]
            owner = np.repeat(np.arange(len(part)), sizes)
            score = np.bincount(owner, w[columns], minlength=len(part))
            cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
            below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -60, 60)))
            full = np.concatenate([np.zeros((len(part), 1)), below, np.ones((len(part), 1))], 1)
            slope = full * (1 - full)
            y, i = grade[part], np.arange(len(part))
            chance = np.maximum(full[i, y + 1] - full[i, y], 1e-9)
            by_score = (slope[i, y + 1] - slope[i, y]) / chance / len(part)
            by_cut = np.zeros((len(part), grades - 1))
            upper, lower = y < grades - 1, y > 0
            by_cut[i[upper], y[upper]] -= (slope[i, y + 1] / chance)[upper]
            by_cut[i[lower], y[lower] - 1] += (slope[i, y] / chance)[lower]
            by_cut = by_cut.mean(0)
            by_theta = np.concatenate([[by_cut.sum()], by_cut[::-1].cumsum()[::-1][1:] * np.exp(theta[1:])])
            slopes = np.bincount(columns, by_score[owner], minlength=len(w))
            seen += slopes**2
            step = rate / np.sqrt(seen)
            w -= step * slopes
            met = slopes != 0
            w[met] = np.sign(w[met]) * np.maximum(np.abs(w[met]) - step[met] * sparsity, 0)
            seen_t += by_theta**2
            theta -= rate / np.sqrt(seen_t) * by_theta
    used = w != 0
    return Model(known[used], w[used], np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: junk, 1: readable but toxic, 2: good. NULL without a quality label."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grades: int = 3) -> Model:
    """Fit on at most `sample` labelled rows; `labels` has doc_id and grade. Of several grades of an id the lowest counts."""
    rated = labels.select(integral(labels, "doc_id").alias("doc_id"), labels["grade"].cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = df.select(integral(df, id_col).alias("doc_id"), df[text_col].alias("text"))
    # `rated` has at most `sample` rows.
    met = texts.join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2), TEXT_BYTES):
                text, feature = features(data, offsets)
                order = np.argsort(text, kind="stable")
                edges = np.searchsorted(text[order], np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(feature[order]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists], ["doc_id", "grade", "features"])

    # Rows that repeat an id count once.
    got = met.mapInArrow(run, "doc_id long, grade int, features array<long>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    grade = got["grade"].to_numpy().astype(int)
    if len(np.unique(grade)) < 2:
        return Model()
    lists = got["features"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return fit_ordinal(row, lists.flatten().to_numpy(zero_copy_only=False), grade, grades)


def grade_documents(df: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_1 and so on, keep.

    tail_j is the chance of grade j or more; a document is kept if the highest tail is at least `least`.

    Defined cases: a NULL text is empty and graded as such. A model without training rows, or with one grade only,
    grades nothing: expected_grade is NULL and all rows are kept. NULL ids and repeated rows stay rows of their own;
    an empty table gives no rows; other columns are ignored.
    """
    top = len(model.thresholds)
    rows = df.select(integral(df, id_col).alias("doc_id"), df[text_col].cast("string").alias("text"))
    if not top:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(True).alias("keep"))
    names = ["doc_id", "expected_grade", *[f"tail_{t + 1}" for t in range(top)], "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1), TEXT_BYTES):
                tails = model.tails(model.scores(data, offsets))
                columns = [pa.array(tails.sum(1)), *[pa.array(tails[:, t]) for t in range(top)], pa.array(tails[:, -1] >= least)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns], names)

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ["long", *["double"] * (top + 1), "boolean"], strict=True)))


def good_documents(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input rows that `grade_documents` keeps, all columns as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(at), TEXT_BYTES):
                tails = model.tails(model.scores(data, offsets))
                yield b.slice(i, j - i).filter(pa.array(tails[:, -1] >= least))

    return df.mapInArrow(run, df.schema) if len(model.thresholds) else df
