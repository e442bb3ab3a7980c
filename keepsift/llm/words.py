"""Words of whole texts as arrays: places, hashes of words and of word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds a task's memory. A longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000

#: The bytes between words: space and 09-0D. All other bytes, of any character, belong to words.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, or the powers of the inverse."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        steps[0] = 1
        _powers[base, inverse] = got = np.multiply.accumulate(steps)
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts that lie one after another in `data`, text i between offsets i and i + 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IN_WORD):
        self.data = data
        inside = in_word[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Word range of text i: low[i] to high[i].
        self.low, self.high = np.searchsorted(self.starts, offsets[:-1]), np.searchsorted(self.starts, offsets[1:])
        self.text = np.repeat(np.arange(len(self.low)), self.high - self.low)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, n), out=sums[1:])
        got = (sums[self.ends] - sums[self.starts]) * powers(_BYTE_BASE, n, True)[self.starts]
        return mixed(got + (self.ends - self.starts).astype(np.uint64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each n words in a row; shorter by n - 1 than `hashes`, empty if there are too few."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, len(hashes)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(_WORD_BASE, len(hashes) - n + 1, True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    got, wide = x, 1
    while wide * 2 <= w:
        got = np.minimum(got[:-wide], got[wide:])
        wide *= 2
    rest = w - wide
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, end row, bytes, offsets); NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
