"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm.scratch import stored
from textquarry.llm.text_stats import STATISTICS, TextCounts
from textquarry.llm.words import crc_of_ids, slices

FOURIER = 192
RIDGE = 1e-2
BINS = 512
SEED = 20240607
#: A document whose score reaches this is predicted to have label 1.
THRESHOLD = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray


def _lifted(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """1, the standardised statistics (clipped to 8 deviations) and FOURIER cosines whose inner products approximate exp(-|x - y|^2 / (2 d))."""
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(STATISTICS, FOURIER)) / np.sqrt(STATISTICS)
    phase = rng.uniform(0, 2 * np.pi, FOURIER)
    return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FOURIER) * np.cos(z @ w + phase)])


def _raw(x: np.ndarray, m: Model) -> np.ndarray:
    return np.clip(_lifted(x, m.mean, m.scale) @ m.weights, -0.5, 1.5)


def scores(x: np.ndarray, m: Model) -> np.ndarray:
    return np.full(len(x), 0.5) if m.weights is None else np.interp(_raw(x, m), m.knots, m.levels)


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text as packed doubles; a null text counts as empty."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            x = TextCounts(data, offsets).statistics()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), STATISTICS)


def _summed(rows: DataFrame, moments) -> np.ndarray | None:
    """Adds up `moments(x, y)`, a flat array, over all rows: inside each partition first, then entry by entry in Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = moments(_matrix(batch.column("x")), np.asarray(batch.column("y")).astype(np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = rows.select("x", "y").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r[1] for r in got]) if got else None


def _pooled(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the rising fit to the bins' label shares, by weight."""
    blocks: list[list[float]] = []
    for k, p in zip(n, positive, strict=True):
        blocks.append([k, p, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(m), p / k) for k, p, m in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learns from every labelled row whose crc32(doc_id as text) mod 5 is not 0: 2 to 4 fit the ridge weights, 1 the calibration."""
    label = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = stored(stats.where(_held_out(F.col("doc_id")) != 0).join(label, "doc_id").select("x", "y", (_held_out(F.col("doc_id")) == 1).alias("later")))
    plain = Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(1), np.zeros(1))
    first = _summed(rows.where("not later"), lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]))
    if first is None or not 0 < first[1] < first[0]:
        return plain
    mean = first[2 : 2 + STATISTICS] / first[0]
    scale = np.sqrt(np.maximum(first[2 + STATISTICS :] / first[0] - mean**2, 1e-12))
    scale = np.where(scale < 1e-5, 1.0, scale)
    d = 1 + STATISTICS + FOURIER
    upper = np.triu_indices(d)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _lifted(x, mean, scale)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = _summed(rows.where("not later"), normal)
    gram = np.zeros((d, d))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    model = Model(mean, scale, np.linalg.solve(gram / first[0] + RIDGE / np.sqrt(first[0]) * np.eye(d), sums[len(upper[0]) :] / first[0]), np.zeros(1), np.zeros(1))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((_raw(x, model) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(np.float64)

    bins = _summed(rows.where("later"), binned)
    if bins is None or not 0 < bins[BINS:].sum() < bins[:BINS].sum():
        bins = _summed(rows, binned)
    seen = np.flatnonzero(bins[:BINS])
    model.knots = (seen + 0.5) / BINS * 2 - 0.5
    model.levels = np.clip(_pooled(bins[:BINS][seen], bins[BINS:][seen]), 0, 1)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id mod 5 is 0, never learnt from), score in 0 to 1, predicted.

    The score is a function of the text alone. A null text counts as empty and is scored like one; a null id keeps its row; repeated rows each
    get theirs. Without labels of both kinds every score is 0.5. Other columns of `docs` are ignored, whatever their names.
    """
    stats = stored(statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = scores(_matrix(batch.column("x")), model.value)
                held = crc_of_ids(batch.column("doc_id").to_pylist()) % 5 == 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold. Statistics of all documents are stored for the fit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(stored(statistics(docs)), labels))

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            yield rows.filter(pa.array(scores(TextCounts(data, offsets).statistics(), model.value) >= threshold))

    return docs.mapInArrow(kept_rows, docs.schema)
