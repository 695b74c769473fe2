"""Embedding whitening: vectors turned to uncorrelated components of unit variance.

Spark sums, in each partition, the moments of the distinct vectors; the driver gets one dimensions x dimensions matrix, which does not grow with
the rows, and solves it by mixed-precision refinement; the components are applied where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.eigen import WIDE, eigenvectors
from textquarry.llm.scratch import stored

COMPONENTS = 16
#: Integers to a unit of a vector's entry, and what is added to them.
STEPS, SHIFT = 64, 1_000_000
#: Entries beyond this many steps are set to it: sums of longs stay longs.
_FAR = float(1 << 40)
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums S, components as rows, their eigenvalues, the trace and the measured distance from the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return self.n * x - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def stepped(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a whole vector of finite entries, with x: floor(64 * entry) + 1000000 of each, as longs."""
    whole = F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    x = F.transform(vector, lambda c: F.floor(F.least(F.lit(_FAR), F.greatest(F.lit(-_FAR), c.cast("double") * STEPS))) + SHIFT)
    return vectors.where(whole).withColumn("x", x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, np.asarray(pc.list_flatten(part.column("x"))).reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for _, x in _blocks(batches):
        n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], ["at", "n", "s"])


def _moments(rows: DataFrame, centre: np.ndarray, turn: Whitening | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of the vectors less `centre`, or of their whitened components, added up by partition and then by entry.

    Sums of products of integers are exact while below 2^53.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for _, x in _blocks(batches):
            y = (x - centre).astype(np.float64) if turn is None else turn.apply(x)
            n += len(y)
            sums = y.sum(axis=0) + (0 if sums is None else sums)
            products = y.T @ y + (0 if products is None else products)
        if n:
            made = np.concatenate([[float(n)], sums, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), pa.array(made)], ["at", "value"])

    found = rows.select("x").mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    made = np.asarray(found.column("value"))[np.argsort(np.asarray(found.column("at")))]
    d = len(centre) if turn is None else len(turn.components)
    return int(made[0]), made[1 : 1 + d], made[1 + d :].reshape(d, d)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of `rows`, all of one length; None without rows or without a component of positive variance.

    Products are summed for vectors less a whole number near their mean, so that the rest of the mean is all that is subtracted after: the
    covariance has no error but that of its last rounding.
    """
    distinct = stored(rows.select("x").distinct())
    sums = distinct.mapInArrow(_sums, "at int, n long, s long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    if not sums:
        return None
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    centre = np.array([round(v / n) for v in s], np.int64)
    _, rest, products = _moments(distinct, centre)
    rest = np.array([v - n * int(m) for v, m in zip(s, centre, strict=True)], WIDE) / n
    covariance = products.astype(WIDE) / n - np.outer(rest, rest)
    values, vectors = eigenvectors((covariance + covariance.T) / 2)
    trace = np.trace(covariance)
    real = min(components, int((values > len(s) * np.finfo(np.float64).eps * max(trace, 0)).sum()))
    if not real:
        return None
    found = Whitening(n, np.array(s, np.int64), vectors[:, :real].T.astype(np.float64), values[:real].astype(np.float64), float(trace))
    _, sums, products = _moments(distinct, centre, found)
    error = np.abs(products / n - np.outer(sums / n, sums / n) - np.eye(real)).max()
    return Whitening(found.n, found.sums, found.components, found.eigenvalues, found.trace, float(error))


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; None where the sum is no long."""
    if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**63:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in d)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row of `vectors` and component, from 1 by falling variance.

    Rows whose vector is null or has null or non-finite entries go, as do those of another length than the most frequent one (the longer, if two
    are). Repeated rows each have rows of their own, but count once in the fit; a null key stays. There are fewer components where the vectors
    have fewer entries or vary in fewer directions: directions without variance have none. A deviation beyond a long is null. Entries beyond
    2^40 / 64 count as that. Without rows, or if all are equal, the result is empty. Other columns are ignored.
    """
    rows = stepped(vectors.select(key, vector), vector).select(key, "x")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).limit(1).collect()
    d = usual[0]["d"] if usual else 0
    rows = rows.where(F.size("x") == d)
    kind = vectors.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(rows, components) if d else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], out)
    explained = found.eigenvalues / found.trace
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.components)
        for batch, x in _blocks(batches):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(_squares(found.deviations(x)), pa.int64())
            same = lambda v, t: pa.array(np.full(len(x) * k, v, t))
            columns = [batch.column(key).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), same(found.n, np.int64), deviation.take(each)]
            columns += [pa.array(found.apply(x).ravel()), pa.array(np.tile(explained, len(x))), same(found.identity_error, np.float64)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(part, out)
