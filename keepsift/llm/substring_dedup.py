"""Substring dedup by super-k-mer partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keepsift.llm.passages import HOT_RUNS, Shape, covered_words, repeated, texts_of, without

WINDOW, MINIMISER = 35, 5


def substring_dedup(
    df: DataFrame,
    window: int = WINDOW,
    minimiser: int = MINIMISER,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans.

    Every word is removed that lies in a window of `window` consecutive words whose words also start anywhere else,
    in another text or in the same. Consecutive windows that share their minimiser, the smallest hash of `minimiser`
    words, travel as one string (a super-k-mer) to the minimiser's bucket. There equal strings follow one another and
    are settled at once; the windows of the others are sorted and compared by their words. Super-k-mers whose
    minimiser occurs once in all texts stay at home, as nothing can equal their windows.
    Minimisers with more than `hot_runs` super-k-mers (or HOT_WORDS words in them) send each window on its own, which spreads over all tasks.

    Defined cases: words are separated by space and 09-0D only. A NULL text has no words. Rows that repeat an id or
    have none are texts of their own, and repeated rows are copies of one another. Texts shorter than a window keep
    all words. Empty tables give no rows; other columns are ignored.
    """
    texts = texts_of(df, id_col, text_col)
    shape = Shape(window, minimiser, window - minimiser + 1, minimiser)
    return without(texts, covered_words(texts, shape, lambda rows: repeated(rows, window), hot_runs))
