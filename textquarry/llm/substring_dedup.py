"""Suffix-array dedup: bytes of repeated strings of `length` bytes go, but for their first occurrence, over all documents.

Texts are kept in slices of about SLICE bytes, compressed, each one row that a task can hold; longer texts are cut into pieces that overlap by less
than `length`. Each slice is parsed into phrases (prefix_free), and slices exchange hashes by Spark shuffles, never texts:

1. Phrases: a window (a string of `length` bytes) that holds a phrase which occurs once in the corpus occurs once itself, and is dropped from here on.
2. The other windows of a slice are put in order by the suffix arrays of its dictionary and its parse; of equal ones the first stands for all.
3. Anchors: windows that start between the same triggers and end between the same ones hold the same run of phrases, their anchor. Where all runs
   of windows around an anchor are one string, all of them are decided at once: the first in the corpus stays, others are repeats.
4. Windows around anchors with several such strings, and those without a whole phrase, are compared one by one, by 96-bit prints.

First means the smaller doc_id, a null one before all; rows of one doc_id are documents of their own, in the order of their slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textquarry.llm import prefix_free
from textquarry.llm.prefix_free import TRIGGER
from textquarry.llm.scratch import stored
from textquarry.llm.words import slices, span_hashes

LENGTH = 100
SLICE = 3 << 19
#: Bytes of text to one bucket of hashes.
BUCKET = 16 << 20
_TEXT, _PIECE, _KEYS, _FLAGS, _LEFT, _KNOWN, _ASKED = range(7)
_NULL = -(1 << 63)
_ROW = "slice long, kind int, part int, a binary, b binary, c binary"
_FIELDS = [("slice", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def _packed(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, its high bytes beside each other."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T), kind)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


@dataclass
class _Slice:
    """Texts one after the other: their ends and ids; windows that start in the first `own` bytes of a text are the slice's."""

    number: int
    kind: int
    data: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    own: np.ndarray
    piece: tuple[int, int] = (0, 0)

    def row(self) -> tuple:
        extra = self.own if self.kind == _TEXT else np.array([*self.own, *self.piece], np.int64)
        return (self.number, self.kind, len(self.data), _packed(self.data), _packed(np.concatenate([self.ends, self.ids])), None if self.kind == _TEXT else _packed(extra))

    @classmethod
    def of(cls, row: dict) -> _Slice:
        ends, ids = np.split(_unpacked(row["b"], np.int64), 2)
        extra = _unpacked(row["c"], np.int64) if row["kind"] == _PIECE else None
        own = np.diff(ends, prepend=0) if extra is None else extra[:1]
        return cls(row["slice"], row["kind"], _unpacked(row["a"], np.uint8), ends, ids, own, (0, 0) if extra is None else tuple(extra[1:].tolist()))

    @property
    def begins(self) -> np.ndarray:
        return np.append(0, self.ends[:-1])


def sliced(documents: DataFrame, length: int = LENGTH, most: int = SLICE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts as rows of slices, their bytes counted in `part`; a slice's texts are in the order of their ids."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, data, offsets in slices(batches, text, most):
            ids = np.array([_NULL if i is None else i for i in rows.column(key).to_pylist()], np.int64)
            made = []
            if len(ids) == 1 and len(data) > most:
                for i, at in enumerate(range(0, len(data), most)):
                    some = data[at : at + most + length - 1]
                    own = np.array([min(most, len(data) - at)], np.int64)
                    made.append(_Slice(number + i, _PIECE, some, np.array([len(some)], np.int64), ids, own, (number, i)))
            else:
                order = np.argsort(ids, kind="stable")
                size = np.diff(offsets)[order]
                whole = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order])
                made.append(_Slice(number, _TEXT, whole, np.cumsum(size), ids[order], size))
            number += len(made)
            yield from (_table([x.row()]).to_batches()[0] for x in made)

    return documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(part, _ROW)


def _keyed(high: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, by its high half."""
    return ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _by_bucket(number: int, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One row of keys for each run of `bucket`; the first column is in order inside a bucket, so its steps are sent."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    more = [None] * (3 - len(columns))
    sent = lambda c, s, e: _packed(np.diff(c[s:e], prepend=c.dtype.type(0)) if c is columns[0] else c[s:e])
    return [(number, _KEYS, int(bucket[s]), *[sent(c, s, e) for c in columns], *more) for s, e in zip(cuts[:-1], cuts[1:], strict=True)] if len(bucket) else []


def _answers(table: pa.Table, bucket: np.ndarray, columns: int) -> np.ndarray:
    """What the buckets said of the keys that `_by_bucket` sent: `columns` bits for each key, in its order."""
    out = np.zeros((len(bucket), columns), bool)
    for r in table.to_pylist():
        if r["kind"] == _FLAGS:
            s, e = np.searchsorted(bucket, [r["part"], r["part"] + 1])
            out[s:e] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=(e - s) * columns).reshape(-1, columns)
    return out


def _exchanged(sent: DataFrame, kinds: tuple[type, ...], decide: Callable[..., np.ndarray]) -> DataFrame:
    """Rows of flags for each slice and bucket of keys: `decide` gets a bucket's columns and the slice of each of its keys."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
        parts = [[_unpacked(r[c], k) for r in rows] for c, k in zip("abc", kinds, strict=False)]
        parts[0] = [np.cumsum(p, dtype=p.dtype) for p in parts[0]]
        sizes = np.array([len(p) for p in parts[0]])
        flags = decide(*[np.concatenate(p) for p in parts], np.repeat(np.arange(len(rows)), sizes))
        ends = np.cumsum(sizes)
        return _table([(r["slice"], _FLAGS, r["part"], np.packbits(flags[e - n : e]).tobytes(), None, None) for r, n, e in zip(rows, sizes, ends, strict=True)])

    return sent.where(F.col("kind") == _KEYS).groupBy("part").applyInArrow(of, _ROW)


def _runs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it, in order."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return new


def _only(key: np.ndarray, several: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Phrases that one slice has once."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(_runs(order, key))
    n = np.add.reduceat(several[order].astype(np.int64) + 1, heads) if len(heads) else heads
    out = np.zeros(len(key), bool)
    out[order[heads]] = n == 1
    return out[:, None]


def _anchored(key: np.ndarray, around: np.ndarray, doc: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Whether the same run of windows is earlier elsewhere; whether its anchor has several such runs."""
    order = np.lexsort((slice_, doc, around, key))
    new, first = _runs(order, key, around), _runs(order, key)
    group = np.cumsum(first) - 1
    several = np.bincount(group, weights=new)[group] > 1 if len(group) else group > 0
    out = np.zeros((len(key), 2), bool)
    out[order, 0], out[order, 1] = ~new, several
    return out


def _earlier(high: np.ndarray, low: np.ndarray, doc: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    order = np.lexsort((slice_, doc, low, high))
    out = np.zeros(len(high), bool)
    out[order] = ~_runs(order, high, low)
    return out[:, None]


def _phrases(s: _Slice, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases between two triggers that fit a window: (start, end) of each, its number, and of each number bucket, key and count less one (at most 1)."""
    at = prefix_free.triggers(s.data, s.ends)
    text = np.searchsorted(s.ends, at, "right")
    ok = np.flatnonzero((text[1:] == text[:-1]) & (np.diff(at) <= length - TRIGGER))
    begin, end = at[ok], at[ok + 1] + TRIGGER
    h = span_hashes(s.data, begin, end)
    keys, number, n = np.unique((_keyed(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
    return begin, end, number, (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32), (n > 1).astype(np.uint8)


def _kept_windows(s: _Slice, length: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) starts of the runs of windows that hold none of these phrases; a run lies in one text."""
    n = len(s.data)
    change = np.zeros(n + 1, np.int32)
    own = np.minimum(s.begins + s.own, s.ends - length + 1)
    some = own > s.begins
    np.add.at(change, s.begins[some], 1)
    np.add.at(change, own[some], -1)
    whole = np.cumsum(change)
    text = np.searchsorted(s.ends, begin, "right")
    low = np.maximum(end - length, s.begins[text])
    change[:] = 0
    change += np.bincount(low, minlength=n + 1).astype(np.int32)
    change -= np.bincount(begin + 1, minlength=n + 1).astype(np.int32)
    alive = (whole[:n] > 0) & (np.cumsum(change)[:n] == 0)
    change = np.diff(alive.astype(np.int8), prepend=0, append=0)  # the last windows of a text end where it does, so runs of two texts never touch
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _printed(data: np.ndarray, at: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(order of the windows that start at these positions by bucket and print, and in it their bucket and print)."""
    high, low = prefix_free.prints(data, at, length)
    order = np.argsort(high, kind="stable")  # buckets go by the high bits
    return order, _keyed(high[order], buckets).astype(np.int64), high[order], low[order]


@dataclass
class _Left:
    """The windows that are left of a slice, as runs with their texts, and groups of those with the same triggers inside."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    length: int

    def __post_init__(self) -> None:
        size = self.ends - self.starts
        self.text_ends = np.cumsum(size + self.length - 1)
        self.text_begins = self.text_ends - size - self.length + 1
        run = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        self.at, self.origin, self.id = self.text_begins[run] + inside, self.starts[run] + inside, self.ids[run]
        cut = prefix_free.triggers(self.data, self.text_ends)
        first, last = np.searchsorted(cut, self.at), np.searchsorted(cut, self.at + self.length - TRIGGER, "right") - 1
        new = np.append(True, (np.diff(first) != 0) | (np.diff(last) != 0) | (np.diff(run) != 0)) if len(run) else np.zeros(0, bool)
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.sizes = np.diff(np.append(self.heads, len(run)))
        self.anchored = last[self.heads] > first[self.heads]
        if len(cut):
            self.span = cut[np.minimum(first[self.heads], len(cut) - 1)], cut[np.maximum(last[self.heads], 0)] + TRIGGER
        else:
            self.span = self.heads, self.heads

    def firsts(self) -> np.ndarray:
        """Whether each window is the first of its content here, by the order of the suffix arrays."""
        out = np.ones(len(self.at), bool)
        if len(self.at):
            place = np.zeros(len(self.data), np.int64)
            place[self.at] = np.arange(len(self.at))
            order, same = prefix_free.window_order(self.data, self.text_begins, self.text_ends, self.length)
            order = place[order]
            heads = np.flatnonzero(~same)
            least = np.minimum.reduceat(order, heads)
            out[order] = order == np.repeat(least, np.diff(np.append(heads, len(order))))
        return out

    def anchors(self, first: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(group, bucket, key, hash of its run of windows, id), in the order of buckets, of the groups with an anchor and a first window."""
        some = np.flatnonzero(self.anchored & np.logical_or.reduceat(first, self.heads)) if len(self.heads) else self.heads
        h = span_hashes(self.data, self.span[0][some], self.span[1][some])
        begin = self.at[self.heads[some]]
        around = span_hashes(self.data, begin, begin + self.sizes[some] + self.length - 1)
        bucket, key = _keyed(h, buckets).astype(np.int64), h.astype(np.uint32)
        order = np.lexsort((key, bucket))
        return tuple(x[order] for x in (some, bucket, key, around, self.id[self.heads[some]]))

    def row(self, number: int, first: np.ndarray) -> tuple:
        return (number, _LEFT, 0, _packed(self.data), _packed(np.concatenate([self.starts, self.ends, self.ids])), _packed(np.packbits(first)))

    @classmethod
    def of(cls, row: dict, length: int) -> tuple[_Left, np.ndarray]:
        left = cls(_unpacked(row["a"], np.uint8), *np.split(_unpacked(row["b"], np.int64), 3), length)
        return left, np.unpackbits(_unpacked(row["c"], np.uint8), count=len(left.at)).astype(bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def repeated_starts(texts: DataFrame, length: int = LENGTH, buckets: int = 1) -> DataFrame:
    """Rows of kind _KNOWN and _FLAGS by slice, which `_starts` turns into the starts of windows that have occurred before."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = _Slice.of(row)
            _, _, _, bucket, key, several = _phrases(s, length, buckets)
            yield from _table(_by_bucket(s.number, bucket, key, several)).to_batches()

    once = _exchanged(texts.mapInArrow(phrases, _ROW), (np.uint32, np.uint8), _only)

    def remaining(key: tuple, table: pa.Table) -> pa.Table:
        s = _Slice.of(next(r for r in table.to_pylist() if r["kind"] in (_TEXT, _PIECE)))
        begin, end, number, bucket, _, _ = _phrases(s, length, buckets)
        lone = _answers(table, bucket, 1)[:, 0][number]
        starts, ends = _kept_windows(s, length, begin[lone], end[lone])
        if not len(starts):
            return _table([])
        size = ends - starts + length - 1
        at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        left = _Left(s.data[at], starts, ends, s.ids[np.searchsorted(s.ends, starts, "right")], length)
        return _table([left.row(s.number, left.firsts())])

    left = stored(texts.union(once).groupBy("slice").applyInArrow(remaining, _ROW))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            mine, first = _Left.of(row, length)
            _, bucket, key, around, ids = mine.anchors(first, buckets)
            yield from _table(_by_bucket(row["slice"], bucket, key, around, ids)).to_batches()

    shared = _exchanged(left.mapInArrow(anchors, _ROW), (np.uint32, np.uint64, np.int64), _anchored)

    def settled(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        row = next(r for r in table.to_pylist() if r["kind"] == _LEFT)
        mine, first = _Left.of(row, length)
        group, bucket, *_ = mine.anchors(first, buckets)
        said = _answers(table, bucket, 2)
        earlier, single = np.zeros(len(mine.heads), bool), ~mine.anchored
        earlier[group], single[group] = said[:, 0], said[:, 1]
        known = ~first | earlier[mine.group]
        asked = np.flatnonzero(first & single[mine.group])
        runs = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
        breaks = np.flatnonzero(np.diff(mine.origin) != 1) + 1
        breaks = breaks[known[breaks] & known[breaks - 1]]
        at = np.sort(np.concatenate([runs, breaks, breaks]))
        known_runs = np.concatenate([mine.origin[at[::2]], mine.origin[at[1::2] - 1] + 1])
        steps = lambda x: _packed(np.diff(x, prepend=0))
        return _table([(number, _KNOWN, 0, _packed(known_runs), steps(mine.origin[asked]), None), (number, _ASKED, 0, row["a"], steps(mine.at[asked]), _packed(mine.id[asked]))])

    known = stored(left.union(shared).groupBy("slice").applyInArrow(settled, _ROW))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, ids = np.cumsum(_unpacked(row["b"], np.int64)), _unpacked(row["c"], np.int64)
            order, bucket, high, low = _printed(_unpacked(row["a"], np.uint8), at, length, buckets)
            yield from _table(_by_bucket(row["slice"], bucket, high, low, ids[order])).to_batches()

    said = _exchanged(known.where(F.col("kind") == _ASKED).mapInArrow(windows, _ROW), (np.uint64, np.uint32, np.int64), _earlier)
    return known.where(F.col("kind") == _KNOWN).union(said)


def _starts(table: pa.Table, data: np.ndarray, length: int, buckets: int) -> np.ndarray:
    """Whether each of a slice's positions starts a window that has occurred before."""
    n = len(data)
    out = np.zeros(n, bool)
    for r in table.to_pylist():
        if r["kind"] == _KNOWN:
            change = np.zeros(n + 1, np.int32)
            begin, end = np.split(_unpacked(r["a"], np.int64), 2)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            out = np.cumsum(change)[:n] > 0
            asked = np.cumsum(_unpacked(r["b"], np.int64))
            order, bucket, *_ = _printed(data, asked, length, buckets)
            out[asked[order[_answers(table, bucket, 1)[:, 0]]]] = True
    return out


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    total = np.cumsum(starts, dtype=np.int32)
    total[length:] -= total[:-length].copy()
    return total > 0


_FIELDS_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, piece struct<serial: long, number: int, removed: binary>"


def remove_repeats(documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_text: bool = True, slice_bytes: int = SLICE, bucket_bytes: int = BUCKET) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of `documents`: its text without the bytes of repeated strings.

    A string of `length` bytes (16 or more) that also starts earlier, in a document of smaller id or further up in the same, loses all its bytes;
    strings are judged on the input and may overlap; n_spans counts the maximal runs removed; kept are the bytes that stay, which need not be
    UTF-8 where a cut falls inside a character, or null if not `with_text`. A null text is empty, a null id comes before all others, rows of equal ids are documents of
    their own of which one comes first. Ids are whole numbers. An empty table gives no rows. Other columns are ignored.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"length must be at least {2 * TRIGGER}")
    kind = documents.schema[key].dataType.simpleString()
    texts = stored(sliced(documents, length, slice_bytes, key, text))
    buckets = max(1, -(-(texts.agg(F.sum("part")).first()[0] or 0) // bucket_bytes))
    known = repeated_starts(texts, length, buckets)

    def kept(slice_: tuple, table: pa.Table) -> pa.Table:
        s = _Slice.of(next(r for r in table.to_pylist() if r["kind"] in (_TEXT, _PIECE)))
        starts = _starts(table, s.data, length, buckets)
        null = lambda ids: [None if i == _NULL else i for i in ids.tolist()]
        if s.kind == _PIECE:
            own = int(s.own[0])
            bits = pa.array([{"serial": s.piece[0], "number": s.piece[1], "removed": np.packbits(starts[:own]).tobytes()}], _PIECE_TYPE)
            return pa.table([pa.array(null(s.ids), pa.int64()), pa.array([own]), pa.array([0]), pa.array([0]), pa.array([None], pa.string()), pa.array([s.data[:own].tobytes()], pa.binary()), bits], names=_OUT)
        gone = _covered(starts, length)
        first = gone & ~np.append(False, gone[:-1])
        first[s.begins[s.begins < len(gone)]] = gone[s.begins[s.begins < len(gone)]]
        sums = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[np.append(0, s.ends)])
        n_removed = sums(gone)
        rest = [(s.data[b:e] if not m else s.data[b:e][~gone[b:e]]).tobytes() for b, e, m in zip(s.begins, s.ends, n_removed, strict=True)]
        digests = [hashlib.sha256(x).hexdigest() for x in rest]
        columns = [pa.array(null(s.ids), pa.int64()), pa.array(np.diff(s.ends, prepend=0)), pa.array(n_removed), pa.array(sums(first)), pa.array(digests), pa.array(rest, pa.binary()) if with_text else pa.nulls(len(rest), pa.binary()), pa.nulls(len(rest), _PIECE_TYPE)]
        return pa.table(columns, names=_OUT)

    found = texts.union(known).groupBy("slice").applyInArrow(kept, _FIELDS_OUT)
    if not texts.where(F.col("kind") == _PIECE).isEmpty():
        found = stored(found)
        found = found.where("piece is null").union(found.where("piece is not null").groupBy("piece.serial").applyInArrow(_joined(length, with_text), _FIELDS_OUT))
    return found.select(F.col("doc_id").cast(kind).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "piece"]
_PIECE_TYPE = pa.struct([("serial", pa.int64()), ("number", pa.int32()), ("removed", pa.binary())])


def _joined(length: int, with_text: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Puts the pieces of a long text together again."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        pieces = table.take(pa.array(np.argsort(pc.struct_field(table.column("piece"), "number").to_numpy())))
        digest, before, rest = hashlib.sha256(), np.zeros(length - 1, bool), []
        n = removed = spans = 0
        gone_before = False
        for i in range(pieces.num_rows):
            data = np.frombuffer(pieces.column("kept")[i].as_buffer(), np.uint8)
            starts = np.unpackbits(np.frombuffer(pieces.column("piece")[i]["removed"].as_buffer(), np.uint8), count=len(data)).astype(bool)
            starts = np.concatenate([before, starts])
            gone = _covered(starts, length)[length - 1 :]
            spans += int((gone & ~np.append(gone_before, gone[:-1])).sum())
            n, removed, gone_before, before = n + len(data), removed + int(gone.sum()), bool(gone[-1]), starts[-(length - 1) :]
            left = data[~gone].tobytes()
            digest.update(left)
            if with_text:
                rest.append(left)
        columns = [table.column("doc_id").slice(0, 1), pa.array([n]), pa.array([removed]), pa.array([spans]), pa.array([digest.hexdigest()]), pa.array([b"".join(rest) if with_text else None], pa.binary()), pa.nulls(1, _PIECE_TYPE)]
        return pa.table(columns, names=_OUT)

    return join
