"""Counts over whole texts, computed for a slice of rows at a time with array operations."""

from __future__ import annotations

import numpy as np

from textquarry.llm.words import SPACE, mixed, span_hashes, spans

#: The characters that the rules call symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _flags(*chars: int) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_SYMBOL = _flags(*SYMBOLS.encode())
_UPPER = _flags(*range(65, 91))
_DIGIT = _flags(*range(48, 58))
_STOP = _flags(*b".,;:?")
_BANG = _flags(*b"!")
_PIPE = _flags(*b"|")
_WIDE = _flags(*range(128, 256))
_LETTER_START = ~_flags(*range(0x80, 0xC0))  # the first byte of each code point


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` between neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mixed(hashes + rows.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each row; rows ascend."""
    if not len(rows):
        return np.zeros(n, np.int64)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(r), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces between \\n."""
    breaks = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    order = np.lexsort((starts, rows))
    return starts[order], ends, rows[order]


class TextCounts:
    """Whole-text counts for the rows of one slice; every attribute has one entry per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.n, self.data, self.offsets = n, data, offsets
        self.starts, self.ends, self.rows = spans(data, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.n_words = np.bincount(self.rows, minlength=n)
        solid = ~SPACE[data] if len(data) else np.zeros(0, bool)
        self.word_chars = per_row(solid & _LETTER_START[data], offsets)
        self.n_symbols = per_row(_SYMBOL[data], offsets)
        start, end, row = lines(data, offsets)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(solid, out=total[1:])
        full = total[end] > total[start]
        start, end, row = start[full], end[full], row[full]
        self.n_lines = np.bincount(row, minlength=n)
        self.n_dup_lines = self.n_lines - _distinct(span_hashes(data, start, end), row, n)
        self.n_repeat_words = self._repeats()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words inside a row."""
        if len(self.rows) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.rows[: len(self.rows) - k + 1] == self.rows[k - 1 :])
        h = np.zeros(len(first), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + self.hashes[first + j]
        return first, mixed(h)

    def _repeats(self) -> np.ndarray:
        """Words in windows that occur at least twice in their row, the first occurrence included."""
        first, h = self.windows(WINDOW)
        keys = _keyed(h, self.rows[first])
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = first[twice[at] == keys]
        cover = np.bincount(hit, minlength=len(self.rows) + WINDOW) - np.bincount(hit + WINDOW, minlength=len(self.rows) + WINDOW)
        return np.bincount(self.rows, weights=np.cumsum(cover)[: len(self.rows)] > 0, minlength=self.n).astype(np.int64)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def statistics(self) -> np.ndarray:
        """n x STATISTICS matrix of sizes and shares of the text alone."""
        n, data, offsets = self.n, self.data, self.offsets
        size = np.diff(offsets).astype(np.float64)
        chars, words, n_lines = np.maximum(size, 1), np.maximum(self.n_words, 1), np.maximum(self.n_lines, 1)
        long = (self.ends - self.starts).astype(np.float64)
        mean = np.bincount(self.rows, weights=long, minlength=n) / words
        spread = np.sqrt(np.maximum(np.bincount(self.rows, weights=long**2, minlength=n) / words - mean**2, 0))
        again = np.zeros(len(self.rows), bool)
        again[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.rows[1:] == self.rows[:-1])
        _, pairs = self.windows(2)
        share = lambda flags: per_row(flags[data], offsets) / chars
        by_word = lambda flags: np.bincount(self.rows, weights=flags, minlength=n) / words
        tail = data[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        return np.column_stack([
            np.log1p(size), np.log1p(self.n_words), mean, spread, share(_SYMBOL), share(_UPPER), share(_DIGIT), share(_STOP), share(_BANG), share(_PIPE), share(_WIDE), share(SPACE),
            self.n_dup_lines / n_lines, self.n_repeat_words / words, _distinct(self.hashes, self.rows, n) / words, by_word(again), by_word(long <= 3), by_word(long > 12),
            by_word(_SYMBOL[tail]), by_word(_BANG[tail]), by_word(long == 1), np.log1p(words / n_lines), np.log1p(self.n_lines),
        ])


STATISTICS = 23
