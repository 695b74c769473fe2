"""Latent semantic vectors of a sparse table of term weights: filtered subspace iteration on its Gram matrix, which is summed by partition in one
pass, or for large vocabularies on block products that read the table each time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from textquarry.sources.shared import stored

_ENTRIES = 16_384  # sparse entries that are multiplied at a time
_SENT = 1_024  # rows of a partial product in one Arrow batch
#: Terms up to which A'A is made once (8 bytes for each two of them, in the driver; half of that in a task); its cells that a task adds up at least; cells
#: and rows handled at a time.
GRAM_TERMS, _CELLS, _AT_ONCE, _GRAM_ROWS = 6_000, 1 << 31, 1 << 18, 64
#: Terms, the most frequent where ids go by that, whose weights are multiplied as dense columns.
_HEAD = 1_024
#: Rows of A'A that come to the driver at a time.
_PIECE = 512

Read = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind, copy=False), offsets - offsets[0]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms met, documents x terms met) of runs of whole documents; repeated terms of a document add up."""
    ids, offsets = _lists(batch.column("ids"), np.int64)
    weights, _ = _lists(batch.column("weights"), np.float64)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _ENTRIES, "right")) - 1)
        a, b = offsets[low], offsets[high]
        met, at = np.unique(ids[a:b], return_inverse=True)
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        yield met, np.bincount(row * len(met) + at, weights[a:b], (high - low) * len(met)).reshape(high - low, len(met))
        low = high


def _rows(of: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * of.shape[1], pa.array(of.reshape(-1)))


def _parts(basis: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A'(A Q) of a partition's documents, a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = basis.value
        total, seen = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            for met, block in _slices(batch):
                total[met] += block.T @ (block @ q[met])
                seen[met] = True
        terms = np.flatnonzero(seen)
        for i in range(0, len(terms), _SENT):
            some = terms[i : i + _SENT]
            yield pa.RecordBatch.from_arrays([pa.array(some), _rows(total[some])], ["term", "part"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial products of this partition's terms added up as they stream in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        values, offsets = _lists(batch.column("part"), np.float64)
        for term, a, b in zip(batch.column("term").to_pylist(), offsets[:-1], offsets[1:], strict=True):
            if term in sums:
                sums[term] += values[a:b]
            else:
                sums[term] = values[a:b].copy()
    yield from _sent(list(sums), sums.__getitem__, _GRAM_ROWS)


def _sent(terms: list[int], row: Callable[[int], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(terms), most):
        rows = [row(t) for t in terms[i : i + most]]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + most], pa.int64()), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.concatenate(rows)))], ["term", "part"])


def _add_pairs(total: np.ndarray, begins: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
    """Adds products of each two weights of a document to the upper triangle; rows of `ids` are documents, whose ids ascend."""
    n = ids.shape[1]
    step = max(1, _AT_ONCE // max(n * len(ids), 1))
    for low in range(0, n, step):
        i, j = np.nonzero(np.arange(low, n) >= np.arange(low, min(low + step, n))[:, None])
        i, j = i + low, j + low
        np.add.at(total, (begins[ids[:, i]] + ids[:, j]).ravel(), (weights[:, i] * weights[:, j]).ravel())


def _gram_parts(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A'A of a partition's documents, a row for each term: up to its diagonal for the first _HEAD terms, for others these and from the diagonal on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = min(_HEAD, terms)
        rest = terms - first
        at = np.arange(rest + 1) * rest - np.arange(rest + 1) * np.arange(-1, rest) // 2  # where rows of the others' triangle begin
        begins, triangle = at[:-1] - np.arange(rest), np.zeros(int(at[-1]))
        head, beside = np.zeros((first, first)), np.zeros((rest, first))
        for batch in batches:
            for low in range(0, batch.num_rows, _SENT):
                some = batch.slice(low, _SENT)
                n, (ids, offsets), (weights, _) = some.num_rows, _lists(some.column("ids"), np.int64), _lists(some.column("weights"), np.float64)
                # repeated terms of a document add up
                cells, same = np.unique(np.repeat(np.arange(n), np.diff(offsets)) * terms + ids, return_inverse=True)
                added, (row, term) = np.bincount(same, weights, len(cells)), np.divmod(cells, terms)
                x = np.zeros((n, first))
                x[row[term < first], term[term < first]] = added[term < first]
                head += x.T @ x
                row, added, term = row[term >= first], added[term >= first], term[term >= first] - first
                order = np.argsort(term, kind="stable")
                met, begin = np.unique(term[order], return_index=True)
                for t, own in zip(met.tolist(), np.split(order, begin[1:]) if len(met) else [], strict=True):
                    beside[t] += added[own] @ x[row[own]]
                size = np.bincount(row, minlength=n)
                begin = np.cumsum(size) - size
                for each in np.unique(size[size > 0]).tolist():
                    alike = begin[size == each]
                    most = max(1, _AT_ONCE // (each * each))
                    for i in range(0, len(alike), most):
                        where = alike[i : i + most, None] + np.arange(each)
                        _add_pairs(triangle, begins, term[where], added[where])
        yield from _sent(list(range(first)), lambda t: head[t, : t + 1], _GRAM_ROWS)
        some = [t for t in range(rest) if beside[t].any() or triangle[at[t] : at[t + 1]].any()]
        for batch in _sent(some, lambda t: np.concatenate([beside[t], triangle[at[t] : at[t + 1]]]), _GRAM_ROWS):
            yield pa.RecordBatch.from_arrays([pa.compute.add(batch.column("term"), first), batch.column("part")], ["term", "part"])

    return run


def _gram(rows: DataFrame, terms: int, read: Read) -> np.ndarray:
    """A'A of all documents, terms x terms: partial sums of some tasks are added up by term, and come to the driver in pieces."""
    context, n = rows.sparkSession.sparkContext, F.size("ids").cast("double")
    cells = rows.agg(F.sum(n * n / 2)).first()[0] or 0
    tasks = int(min(max(1, -(-cells // _CELLS)), context.defaultParallelism))
    add = _gram_parts(terms)
    parts = rows.coalesce(tasks).mapInArrow(lambda batches: add(read(batches)), "term long, part array<double>")
    summed = stored(parts.repartition("term").mapInArrow(_summed, "term long, part array<double>"))
    out = np.zeros((terms, terms))
    for low in range(0, terms, _PIECE):
        for batch in summed.where(F.col("term").between(low, low + _PIECE - 1)).toArrow().to_batches():
            values, offsets = _lists(batch.column("part"), np.float64)
            for term, a, b in zip(batch.column("term").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                head = min(term + 1, _HEAD)
                out[term, :head] = out[:head, term] = values[a : a + head]
                if term >= _HEAD:
                    out[term, term:] = out[term:, term] = values[a + head : b]
    return out


def _product(rows: DataFrame, q: np.ndarray, read: Read) -> np.ndarray:
    """A'A Q of all documents; terms x columns come to the driver, a size that the vocabulary bounds."""
    context = rows.sparkSession.sparkContext
    basis = context.broadcast(q)
    # a partial product has the basis' size: one for each core, however many rows there are
    made = rows.coalesce(context.defaultParallelism).mapInArrow(lambda batches: _parts(basis)(read(batches)), "term long, part array<double>").repartition("term").mapInArrow(_summed, "term long, part array<double>")
    found, out = made.toArrow(), np.zeros_like(q)
    for batch in found.to_batches():
        values, _ = _lists(batch.column("part"), np.float64)
        out[batch.column("term").to_numpy()] = values.reshape(-1, q.shape[1])
    basis.destroy()
    return out


def right_vectors(rows: DataFrame, terms: int, dimensions: int, extra: int = 32, tolerance: float = 1e-4, most_products: int = 60, seed: int = 7, read: Read = iter) -> np.ndarray:
    """The first right singular vectors of `rows`, of which `read` makes (ids, weights), as columns; each one's largest entry is positive.

    A Gaussian start of `extra` more columns is improved by Chebyshev polynomials of A'A that grow above the block's smallest Ritz value, until the
    subspace turns by less than `tolerance` (as a sine) or after `most_products` products. Up to GRAM_TERMS terms A'A is made in one pass over the rows;
    beyond that each product reads the rows once. A polynomial's degree is held to a growth of 1e8, beyond which the last vectors would drown in the first one's rounding. Vectors whose squared singular value is below
    1e-12 of the first are left out.
    """
    width = min(dimensions + extra, terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    v, products = np.zeros((terms, 0)), 0
    whole = _gram(rows, terms, read) if terms <= GRAM_TERMS else None
    times = (lambda q: _product(rows, q, read)) if whole is None else whole.__matmul__
    while products < most_products:
        z, products = times(q), products + 1
        values, turned = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, z = q @ turned, z @ turned
        keep = min(dimensions, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
        before, v = v, q[:, :keep]
        if before.shape == v.shape and (not v.size or np.linalg.norm(v - before @ (before.T @ v), 2) < tolerance):
            break
        end = values[-1]
        if end <= 1e-10 * values[0]:
            q = np.linalg.qr(z)[0]
            continue
        degree = int(np.clip(np.arccosh(1e8) / np.arccosh(max(2 * values[0] / end - 1, 1 + 1e-9)), 1, 8))
        last, now = q, 2 / end * z - q
        for _ in range(min(degree, most_products - products) - 1):
            last, now = now, 2 * (2 / end * times(now) - now) - last
            products += 1
        q = np.linalg.qr(now)[0]
    return v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])]) if v.size else v


def latent_vectors(weights: DataFrame, dimensions: int = 256, key: str = "doc_id", most_terms: int = 50_000, **options: float) -> DataFrame:
    """(key, embedding): documents of the sparse (key, term, weight) table projected on its first right singular vectors, at unit length.

    The weights are grouped and stored once, with terms as numbers. The vocabulary may have at most `most_terms` terms: matrices of terms x (dimensions + extra) are broadcast and made orthonormal on the driver.
    Null terms and weights are left out, repeated ones add up; a document without a weight has no row, one whose projection is zero gets zeros.
    """
    clean = weights.select(F.col(key).alias("key"), "term", F.col("weight").cast("double").alias("weight")).where("term is not null and weight is not null")
    grouped = stored(clean.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("f")))
    some = grouped.select(F.explode("f.term").alias("term")).distinct().limit(most_terms + 1).toArrow().column("term")
    terms = len(some)
    if terms > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    known = weights.sparkSession.sparkContext.broadcast(sorted(some.to_pylist()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(known.value)
        for batch in batches:
            found = batch.column("f")
            own = found.flatten()
            lists = [pa.ListArray.from_arrays(pa.compute.subtract(found.offsets, found.offsets[0]), x) for x in (pa.compute.index_in(own.field("term"), value_set=names), own.field("weight"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "ids", "weights"])

    kind = clean.select("key").schema[0].dataType.simpleString()
    return latent_rows(stored(grouped.mapInArrow(numbered, f"key {kind}, ids array<int>, weights array<double>")).withColumnRenamed("key", key), terms, dimensions, key, **options)


def latent_rows(rows: DataFrame, terms: int, dimensions: int = 256, key: str = "doc_id", read: Read = iter, **options: float) -> DataFrame:
    """The same of rows (key, ids, weights) whose ids are below `terms`, or of rows of which `read` makes such; they are read several times, so they should
    be stored."""
    kind = rows.schema[key].dataType.simpleString()
    v = right_vectors(rows, terms, dimensions, read=read, **options) if terms else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for batch in read(batches):
            if not batch.num_rows:
                continue
            y = np.concatenate([block @ basis[met] for met, block in _slices(batch)])
            y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-10
            yield pa.RecordBatch.from_arrays([batch.column(key), _rows(y)], [key, "embedding"])

    return rows.mapInArrow(project, f"`{key}` {kind}, embedding array<double>")
