"""Prefix-free parsing of a batch of texts: phrases between rolling-hash triggers, and the order of all windows from two small suffix arrays.

A trigger is a string of TRIGGER bytes whose hash is small. A phrase runs from one trigger to the end of the next, so that neighbours share a
trigger and no phrase (nor a suffix of one that is longer than a trigger) is a proper prefix of another. Every suffix of a text is then ordered
by the suffix of its phrase, whose rank is in the suffix array of the dictionary of distinct phrases, and where those are equal by the phrases
that follow, whose rank is in the suffix array of the parse. Repeated text is in the dictionary once.
"""

from __future__ import annotations

import numpy as np

from textquarry.llm.words import mixed, span_hashes

TRIGGER, MEAN = 8, 12
_SMALL = np.uint64((1 << 64) // MEAN)
#: Bytes of a suffix that its first rank looks at.
_FIRST = 7


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as integers, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,)) if len(data) > 7 else np.zeros(0, np.uint64)


def triggers(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions at which a trigger starts that lies in one text; `ends` are the texts' ends."""
    h = eights(np.ascontiguousarray(data)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(h < _SMALL)
    return at[ends[np.searchsorted(ends, at, "right")] >= at + TRIGGER] if len(at) else at


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each phrase's content, a phrase of each number). Hashes propose, bytes decide."""
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][number]
    if same.all():
        begin = np.repeat(np.cumsum(size) - size, size)
        inside = np.arange(len(begin)) - begin
        same = np.array_equal(data[np.repeat(starts, size) + inside], data[np.repeat(starts[first][number], size) + inside])
    else:
        same = False
    if not same:  # two contents of one hash
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends, strict=True)], np.int64)
        _, first = np.unique(number, return_index=True)
    return number, first


class _Ranks:
    """Ranks of suffixes that are refined step by step: a suffix's rank is how many have a smaller key, and only tied ones are sorted again."""

    def __init__(self, keys: np.ndarray):
        self.rank = np.empty(len(keys), np.int64)
        self.tied = np.argsort(keys, kind="stable")
        self._place(keys[self.tied], np.arange(len(keys)))

    def _place(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """keys of self.tied, in order, which lie in these slots of the whole order."""
        if not len(keys):
            return
        new = np.append(True, keys[1:] != keys[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(keys)))
        self.rank[self.tied] = np.repeat(slots[heads], size)
        more = np.repeat(size > 1, size)
        self.tied, self.slots = self.tied[more], slots[more]

    def refine(self, apart: int, left: np.ndarray) -> None:
        """By the rank `apart` further on; where no more than that are `left` nothing follows, which comes first."""
        if not len(self.tied):
            return
        n = len(self.rank)
        far = np.minimum(self.tied + apart, n - 1)
        keys = self.rank[self.tied] * np.int64(n + 1) + np.where(left[self.tied] > apart, self.rank[far] + 1, 0)
        order = np.argsort(keys, kind="stable")
        self.tied = self.tied[order]
        self._place(keys[order], self.slots)


def dictionary_ranks(words: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix of the phrases in `words`, one after the other, by its first `length` bytes; `left`: bytes to its phrase's end."""
    padded = np.concatenate([words, np.zeros(8, np.uint8)])
    key = eights(padded)[: len(words)].byteswap() >> np.uint64(8)
    short = np.minimum(left, _FIRST).astype(np.uint64)
    beyond = np.uint64(8) * (np.uint64(_FIRST) - short)
    ranks, depth = _Ranks((((key >> beyond) << beyond) << np.uint64(8)) | short), _FIRST  # nothing of the next phrase
    while depth < length:
        apart = min(depth, length - depth)
        ranks.refine(apart, left)
        depth += apart
    return ranks.rank


def parse_ranks(symbols: np.ndarray, starts: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix of the parse, far enough to tell apart what differs in `length` bytes; `left`: phrases to its text's end."""
    ranks, depth = _Ranks(symbols), 1
    while len(ranks.tied) and len(starts) > depth and (np.where(left[:-depth] > depth, starts[depth:] - starts[:-depth], length) < length).any():
        ranks.refine(depth, left)
        depth *= 2
    return ranks.rank


def window_order(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of `length` bytes in text order of their content, whether each equals the one before it).

    The texts are data[begins[i]:ends[i]], one after the other and each of `length` bytes or more.
    """
    cut = triggers(data, ends)
    starts = np.union1d(begins, cut)
    text = np.searchsorted(ends, starts, "right")
    last = np.append(text[1:] != text[:-1], True)
    ended = np.where(last, ends[text], np.append(starts[1:], 0) + TRIGGER)
    number, first = _distinct(data, starts, ended)
    size = (ended - starts)[first]
    at = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(at, size)
    words, left = data[np.repeat(starts[first], size) + place], np.repeat(size, size) - place
    ranks = dictionary_ranks(words, left, length)
    places = np.flatnonzero(last)
    parse = parse_ranks(ranks[at[number]], starts, places[np.searchsorted(places, np.arange(len(starts)))] - np.arange(len(starts)) + 1, length)

    windows = ends - begins - length + 1
    w = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    k = np.searchsorted(starts, w, "right") - 1
    rank = ranks[at[number[k]] + w - starts[k]]
    inside = ended[k] - w >= length
    follows = np.where(inside, 0, parse[np.minimum(k + 1, len(parse) - 1)] + 1)
    order = np.argsort(rank * np.int64(len(parse) + 2) + follows, kind="stable")
    same = np.append(False, rank[order[1:]] == rank[order[:-1]])
    unsure = np.flatnonzero(same & ~inside[order])
    one, two, x = w[order[unsure]], w[order[unsure - 1]], eights(data)
    equal = np.ones(len(unsure), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        equal &= x[one + at] == x[two + at]
    same[unsure] = equal
    return w[order], same


def prints(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the `length` bytes from each position on."""
    x = eights(data)
    one, two = np.zeros(len(at), np.uint64), np.full(len(at), 0xD6E8FEB86659FD93, np.uint64)
    factor = np.uint64(0xA0761D6478BD642F)
    for step in [*range(0, length - 8, 8), length - 8]:
        part = x[at + step]
        one = mixed(one ^ part)
        factor = mixed(np.array([factor]))[0] | np.uint64(1)
        two = two + (part ^ (part >> np.uint64(32))) * factor
    return one, (mixed(two) >> np.uint64(32)).astype(np.uint32)
