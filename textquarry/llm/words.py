"""Words and their hashes over whole Arrow batches: text bytes stay in one NumPy array, nothing is done row by row.

A word is a run of bytes other than the six ASCII white-space characters, which equals `[^\\x20\\x09-\\x0D]+` on code points because UTF-8
never uses those bytes inside a longer character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes of text that are expanded to 64-bit integers at once.
WINDOW = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about `most` bytes of text; a longer text is a run of its own. Null counts as empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
        size = np.asarray(pc.binary_length(column)).astype(np.int64)
        ends = np.cumsum(size)
        first = 0
        while first < len(size):
            before = ends[first] - size[first]
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            part = column.slice(first, last - first)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = part.buffers()[2]
            whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(first, last - first), whole[offsets[0] : offsets[-1]], offsets - offsets[0]
            first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begins, ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[begins] = solid[begins]
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def _grown(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        n = max(n + 1, 2 * len(_POWERS))
        step = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _POWERS, _INVERSES = np.cumprod(step), np.cumprod(back)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * power[i] before each position, and inverse powers: (sum[e] - sum[s]) * inverse[s] depends on data[s:e] alone."""
    _grown(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=total[1:])
    return total, _INVERSES


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, inverses = prefix_sums(data)
    return (total[ends] - total[starts]) * inverses[starts]


def _long_sum(data: np.ndarray) -> np.uint64:
    """_sums of one span longer than WINDOW, a window at a time."""
    power, total = 1, 0
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW]
        total += power * int(prefix_sums(part)[0][-1])
        power = power * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span lies. Spans are in order; memory beside the result follows WINDOW, not the text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) <= WINDOW:
        sums = _sums(data, starts, ends)
    else:
        sums = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = at + int(np.searchsorted(ends[at:], low + WINDOW, "right"))
            if to == at:
                sums[at] = _long_sum(data[low : int(ends[at])])
                to = at + 1
            else:
                sums[at:to] = _sums(data[low : int(ends[to - 1])], starts[at:to] - low, ends[at:to] - low)
            at = to
    return mixed(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def crc_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id written as text; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids], np.int64)


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
