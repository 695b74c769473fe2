"""SentencePiece encoding and decoding with suffix-array matching.

For a batch of texts the distinct word units (spaces and the word after them; no piece crosses units) are concatenated. The positions of that
text are sorted by what follows, every piece's occurrences are one range found by binary search, the ranges are unrolled into edges (position,
length, piece) and sorted by position. The edges are then relaxed. The models at hand are merge (BPE) models, whose scores are merge ranks
and not log probabilities, so a sum-of-scores relaxation would give other pieces than the model defines; edges are relaxed in merge order:
again and again, in every unit at once, the adjacent pair whose joint edge has the best rank (leftmost among equals) becomes one edge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm.words import slices, span_hashes

#: The model file; any merge model with byte fallback and a dummy prefix will do.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Units of more characters than this are merged one by one with a heap, since lockstep rounds would grow with their length.
LOCKSTEP = 192
#: Bytes of text that are indexed at once; a longer text is cut between word units.
SLICE = 1 << 20
_NONE = np.int64(1) << 30


@dataclass
class Vocabulary:
    """Pieces as bytes (space marks as plain spaces), their ranks, and the id of each fallback byte."""

    pieces: list[bytes]
    rank: np.ndarray  # by id; equal scores have equal ranks
    matched: np.ndarray  # ids of the pieces that text can match
    bytes: np.ndarray  # id of each byte's fallback piece, or the unknown id
    unknown: int

    @cached_property
    def columns(self) -> int:
        """64-bit integers that hold the longest piece."""
        return (int(self.size[self.matched].max()) + 7) // 8

    @cached_property
    def size(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces])

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest key of what begins with each matched piece, as rows of `columns` integers."""
        low, high = (np.frombuffer(b"".join(self.pieces[i].ljust(8 * self.columns, fill) for i in self.matched), ">u8").astype(np.uint64) for fill in (b"\0", b"\xff"))
        return low.reshape(-1, self.columns), high.reshape(-1, self.columns)

    @cached_property
    def store(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes in one array, and where each begins."""
        return np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(self.size) - self.size


def load(path: str = MODEL_PATH) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces, fallback, matched = [], np.full(256, m.unk_id(), np.int32), []
    for i in range(n):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            fallback[int(piece[3:5], 16)] = i
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(SPACE_MARK, " ").encode())
            if not m.is_unused(i):
                matched.append(i)
    score = np.array([m.get_score(i) for i in range(n)])
    return Vocabulary(pieces, np.unique(-score, return_inverse=True)[1].astype(np.int64), np.array(matched), fallback, m.unk_id())


def _keys(data: np.ndarray, left: np.ndarray, n: int) -> list[np.ndarray]:
    """Big-endian integers of bytes 0-7, 8-15, ... after each position, zero past the unit's end (`left`: bytes up to it)."""
    keys = []
    padded = np.concatenate([data, np.zeros(8 * n, np.uint8)])
    for k in range(n):
        key = np.zeros(len(data), np.uint64)
        for j in range(8 * k, 8 * k + 8):
            key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + len(data)], 0).astype(np.uint64)
        keys.append(key)
    return keys


class Edges:
    """All occurrences of all pieces in a text of concatenated units, sorted by position and length."""

    def __init__(self, data: np.ndarray, left: np.ndarray, vocabulary: Vocabulary):
        keys = _keys(data, left, vocabulary.columns)
        suffixes = np.lexsort(keys[::-1])
        for k, key in enumerate(keys):
            keys[k] = key[suffixes]
        size, (low, high) = vocabulary.size[vocabulary.matched], vocabulary.bounds
        first, last = np.searchsorted(keys[0], low[:, 0], "left"), np.searchsorted(keys[0], high[:, 0], "right")
        for at in np.flatnonzero((size > 8) & (last > first)):
            for k in range(1, (size[at] + 7) // 8):
                part = keys[k][first[at] : last[at]]
                first[at], last[at] = first[at] + np.searchsorted(part, low[at, k], "left"), first[at] + np.searchsorted(part, high[at, k], "right")
        n_found = last - first
        piece = np.repeat(np.arange(len(size)), n_found)
        at = np.repeat(first - (np.cumsum(n_found) - n_found), n_found) + np.arange(n_found.sum())
        packed = np.sort((suffixes[at].astype(np.uint64) << np.uint64(32)) | (size[piece].astype(np.uint64) << np.uint64(24)) | vocabulary.matched[piece].astype(np.uint64))
        position = (packed >> np.uint64(32)).astype(np.int64)
        self.piece = (packed & np.uint64(0xFFFFFF)).astype(np.int64)
        self.begin = np.searchsorted(position, np.arange(len(data) + 1))
        self.lengths = np.bincount(position, weights=2.0 ** ((packed >> np.uint64(24)) & np.uint64(0xFF)).astype(np.int64), minlength=len(data)).astype(np.uint64)

    def find(self, position: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece at `position` with `length` bytes, -1 if there is none."""
        bit = np.uint64(1) << np.minimum(length, 63).astype(np.uint64)
        mask = self.lengths[position]
        at = self.begin[position] + np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where((mask & bit) > 0, self.piece[np.minimum(at, max(len(self.piece) - 1, 0))] if len(self.piece) else -1, -1)


def _heap_merge(start: list[int], end: int, edges: Edges, rank: np.ndarray) -> list[int]:
    """Start positions of the final pieces of one long unit."""
    n = len(start)
    ends, before, after = [*start[1:], end], list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: list[int]) -> None:
        i = [x for x in i if x >= 0 and after[x] >= 0]
        if i:
            s, e = np.array([start[x] for x in i]), np.array([ends[after[x]] for x in i])
            for x, p, stop in zip(i, edges.find(s, e - s).tolist(), e.tolist(), strict=True):
                if p >= 0:
                    heapq.heappush(heap, (int(rank[p]), x, ends[x], stop))

    offer(list(range(n)))
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ends[i] != mid or j < 0 or ends[j] != stop:
            continue
        alive[j], ends[i], after[i] = False, stop, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer([before[i], i])
    return [s for s, a in zip(start, alive, strict=True) if a]


def _relaxed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, edges: Edges, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the final pieces of all units, in order."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    unit = np.searchsorted(begins, start, "right") - 1
    first_of = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    if len(first_of) and (start[first_of] != begins[unit[first_of]]).any():  # bytes that begin with the rest of a character: not text
        raise ValueError("text is not UTF-8")
    done_s, done_e = [], []
    n = np.bincount(unit, minlength=len(begins))
    for u in np.flatnonzero(n > LOCKSTEP):
        mine = start[np.searchsorted(unit, u, "left") : np.searchsorted(unit, u, "right")].tolist()
        got = np.array(_heap_merge(mine, int(ends[u]), edges, rank))
        done_s.append(got)
        done_e.append(np.append(got[1:], ends[u]))
    some = n[unit] <= LOCKSTEP
    start, unit = start[some], unit[some]
    stop = np.empty(len(start), np.int64)
    stop[:-1] = start[1:]
    last = np.ones(len(start), bool)
    last[:-1] = unit[1:] != unit[:-1]
    stop[last] = ends[unit[last]]

    def ranks(i: np.ndarray) -> np.ndarray:
        j = np.minimum(i + 1, len(start) - 1)
        p = edges.find(start[i], stop[j] - start[i])
        return np.where((p >= 0) & (unit[j] == unit[i]) & (j > i), rank[p], _NONE)

    best = ranks(np.arange(len(start))) if len(start) else np.zeros(0, np.int64)
    while len(start):
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        key = np.minimum.reduceat(best << np.int64(32) | np.arange(len(start)), heads)
        going = key < (_NONE << np.int64(32))
        size = np.diff(np.append(heads, len(start)))
        stays = np.repeat(going, size)
        if not going.all():
            done_s.append(start[~stays])
            done_e.append(stop[~stays])
        if not going.any():
            break
        i = key[going] & ((1 << 32) - 1)
        stop[i] = stop[i + 1]
        stays[i + 1] = False
        moved = np.cumsum(stays) - 1
        start, stop, unit, best = start[stays], stop[stays], unit[stays], best[stays]
        i = moved[i]
        again = np.concatenate([i, i[i > 0] - 1])
        best[again] = ranks(again)
    s = np.concatenate(done_s) if done_s else np.zeros(0, np.int64)
    e = np.concatenate(done_e) if done_e else np.zeros(0, np.int64)
    order = np.argsort(s)
    return s[order], e[order]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with space marks as spaces and a space before each text that isn't empty."""
    mark = np.frombuffer(SPACE_MARK.encode(), np.uint8)
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, np.int64)
    if len(at):
        data = data.copy()
        data[at] = 32
        keep = np.ones(len(data), bool)
        keep[at + 1] = keep[at + 2] = False
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
    full = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate([[0], np.cumsum(full)])


def encode_slice(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the (prefixed) texts, and where each text's ids begin."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    new = np.zeros(len(data), bool)
    new[1:] = (data[1:] == 32) & (data[:-1] != 32)
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(data))
    _, sample, which = np.unique(span_hashes(data, begins, ends), return_index=True, return_inverse=True)
    size = (ends - begins)[sample]
    text = data[_spread(begins[sample], size)]
    unit_ends = np.cumsum(size)
    left = np.repeat(unit_ends, size) - np.arange(len(text))
    edges = Edges(text, left, vocabulary)
    start, stop = _relaxed(text, unit_ends - size, unit_ends, edges, vocabulary.rank)
    piece = edges.find(start, stop - start)
    has_bytes = (vocabulary.bytes != vocabulary.unknown).all()
    n = np.where((piece < 0) & has_bytes, stop - start, 1)
    ids = np.repeat(np.where(piece < 0, vocabulary.unknown, piece), n).astype(np.int32)
    if has_bytes:
        bare = np.repeat(piece < 0, n)
        ids[bare] = vocabulary.bytes[text[_spread(start, n)[bare]]]
    id_ends = np.concatenate([[0], np.cumsum(n)])
    unit_first = id_ends[np.searchsorted(start, unit_ends - size)]
    unit_n = np.diff(np.append(unit_first, len(ids)))
    count = unit_n[which]
    total = np.concatenate([[0], np.cumsum(count)])
    return ids[_spread(unit_first[which], count)], total[np.searchsorted(begins, offsets)]


def decode_slice(ids: np.ndarray, begins: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the (prefixed) texts and their offsets."""
    size, (store, place) = vocabulary.size, vocabulary.store
    total = np.concatenate([[0], np.cumsum(size[ids])])
    return store[_spread(place[ids], size[ids])], total[begins]


def checked_slice(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of the (prefixed) texts, where each text's ids begin, and whether decoding them gives the text again."""
    ids, begins = encode_slice(data, offsets, vocabulary)
    back, back_offsets = decode_slice(ids, begins, vocabulary)
    same = back_offsets[1:] - back_offsets[:-1] == offsets[1:] - offsets[:-1]
    if len(back) == len(data):
        wrong = np.concatenate([[0], np.cumsum(back != data)])
        same &= wrong[offsets[1:]] == wrong[offsets[:-1]]
    else:
        same &= np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(back_offsets, back_offsets[1:], offsets, offsets[1:], strict=False)], bool)
    return ids, begins, same


def long_text(data: np.ndarray, vocabulary: Vocabulary, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one text, in windows of about `most` bytes that begin where word units begin; no piece crosses units."""
    units = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
    at = np.searchsorted(units, np.arange(most, len(data), most))
    cuts = np.unique(np.concatenate([[0], units[at[at < len(units)]], [len(data)]]))
    parts = [checked_slice(data[a:b], np.array([0, b - a]), vocabulary) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    ids = np.concatenate([x for x, _, _ in parts])
    return ids, np.array([0, len(ids)]), np.array([all(same.all() for _, _, same in parts)])


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, round_trip, ids.

    ids are those of the SentencePiece model; decoding them gives the text again (round_trip), except that a space mark U+2581 in the text comes
    back as a space. A null or empty text has no ids (a null one round-trips to an empty one). Null ids and repeated rows are encoded each for
    itself; other columns of `docs` are ignored. A very long text is indexed in windows; only its ids are held whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model_path))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for rows, raw, raw_offsets in slices(batches, "text", SLICE):
            data, offsets = prefixed(raw, raw_offsets)
            ids, begins, same = long_text(data, v, SLICE) if rows.num_rows == 1 and len(data) > SLICE else checked_slice(data, offsets, v)
            same &= (np.diff(raw_offsets) == np.maximum(np.diff(offsets) - 1, 0))
            n = np.diff(begins)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), pa.array(same), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))], ["doc_id", "n_tokens", "round_trip", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, round_trip boolean, ids array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of rows with `ids`. Null ids give null text; bytes that are not UTF-8 are replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value.pieces
        for batch in batches:
            texts = [None if x is None else b"".join(pieces[i] for i in x)[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(part, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
