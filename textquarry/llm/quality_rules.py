"""Quality rules: base counts with fixed limits, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.text_stats import TextCounts
from textquarry.llm.words import crc_of_ids, slices

#: log2 of the slots of each n-gram kind: one word, two words, three and four bytes.
BITS = 17
KINDS = 4
#: Most labelled rows that the fit takes, the first by hash of their id.
MAX_LABELLED = 6000
THRESHOLD = 0.5


def _byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    if len(data) < k:
        return np.zeros(0, np.uint32)
    h = data[: len(data) - k + 1].astype(np.uint32)
    for j in range(1, k):
        h = h | (data[j : len(data) - k + 1 + j].astype(np.uint32) << np.uint32(8 * j))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def _gram_slots(counts: TextCounts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: slot of every n-gram in text order, and where each row's n-grams begin and end."""
    out = []
    word_ends = np.cumsum(counts.n_words)
    word_begins = word_ends - counts.n_words
    out.append(((counts.hashes >> np.uint64(64 - BITS)).astype(np.int64), word_begins, word_ends))
    first, h = counts.windows(2)
    n = np.maximum(counts.n_words - 1, 0)
    out.append(((h >> np.uint64(64 - BITS)).astype(np.int64), np.cumsum(n) - n, np.cumsum(n)))
    for k in (3, 4):
        begins = counts.offsets[:-1]
        out.append((_byte_grams(counts.data, k), begins, np.maximum(counts.offsets[1:] - k + 1, begins)))
    return out


def linear_scores(counts: TextCounts, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + the mean weight of each kind of n-gram, per row."""
    z = np.full(counts.n, bias)
    for kind, (slots, begins, ends) in enumerate(_gram_slots(counts)):
        total = np.zeros(len(slots) + 1)
        np.cumsum(weights[kind << BITS : (kind + 1) << BITS].take(slots), out=total[1:], dtype=np.float64)
        most = len(slots)
        z += (total[np.minimum(ends, most)] - total[np.minimum(begins, most)]) / np.maximum(ends - begins, 1)
    return z


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, held: np.ndarray, epochs: int = 8, size: int = 128) -> tuple[np.ndarray, float, float, float]:
    """Adagrad on log loss over mini-batches in a fixed order, then a Platt fit (two Newton-solved numbers) on the held-out rows."""
    w, bias = np.zeros(KINDS << BITS, np.float32), 0.0
    squares, bias_square = np.full(KINDS << BITS, 1e-8, np.float32), 1e-8
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(train)
        for at in range(0, len(order), size):
            mine = order[at : at + size]
            long = np.array([len(rows[i][0]) for i in mine])
            slot = np.concatenate([rows[i][0] for i in mine])
            value = np.concatenate([rows[i][1] for i in mine])
            row = np.repeat(np.arange(len(mine)), long)
            z = np.bincount(row, weights=w[slot] * value, minlength=len(mine)) + bias
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[mine]
            g = np.bincount(slot, weights=value * err[row], minlength=len(w)).astype(np.float32) / len(mine)
            squares += g * g
            w -= 0.3 * g / np.sqrt(squares)
            gb = err.mean()
            bias_square += gb * gb
            bias -= 0.3 * gb / np.sqrt(bias_square)
    check = np.flatnonzero(held) if held.any() and len(set(label[held])) == 2 else np.arange(len(rows))
    z = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in check])
    y = label[check]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([np.sum((p - y) * z) + 1e-3 * (a - 1), np.sum(p - y)])
        h = np.array([[np.sum(s * z * z) + 1e-3, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return w, bias, float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias and calibration from at most `max_labelled` labelled rows; None unless both labels occur.

    The sample's size is a bound on what is broadcast, shuffled and given to the one fitting task.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            kinds, slots, values = _gram_slots(TextCounts(data, offsets)), [], []
            for i in range(rows.num_rows):
                s, v = [], []
                for kind, (slot, begins, ends) in enumerate(kinds):
                    got, n = np.unique(slot[begins[i] : ends[i]], return_counts=True)
                    s.append(got.astype(np.int32) + (kind << BITS))
                    v.append((n / max(ends[i] - begins[i], 1)).astype(np.float32))
                slots.append(np.concatenate(s).tobytes())
                values.append(np.concatenate(v).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(crc_of_ids(rows.column("doc_id").to_pylist())), rows.column("quality").cast(pa.int32()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["crc", "quality", "slots", "values"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        label = np.array([x[1] > 0 for x in found], np.float64)
        if len(set(label)) == 2:
            rows = [(np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.float32)) for x in found]
            w, bias, a, b = _fit(rows, label, np.array([x[0] % 5 == 1 for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias]), pa.array([a]), pa.array([b])], ["w", "bias", "a", "b"])

    got = sample.mapInArrow(featured, "crc long, quality int, slots binary, values binary").repartition(1).mapInArrow(fitted, "w binary, bias double, a double, b double").collect()
    return (np.frombuffer(got[0][0], np.float32), got[0][1], got[0][2], got[0][3]) if got else None


def _judged(data: np.ndarray, offsets: np.ndarray, model, threshold: float) -> tuple[TextCounts, np.ndarray, np.ndarray, np.ndarray]:
    counts = TextCounts(data, offsets)
    failed = counts.base_failed()
    if model is None:
        p = np.ones(counts.n)
    else:
        w, bias, a, b = model
        p = 1 / (1 + np.exp(-np.clip(a * linear_scores(counts, w, bias) + b, -30, 30)))
    return counts, failed, p, ~failed & (p >= threshold)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, probability (calibrated, that the label is 1) and kept.

    kept is false for documents that fail the base limits, else probability >= threshold. A null text counts as empty (no words, base_failed); a
    null id keeps its row; repeated rows are judged alike, each for itself; without both labels among `labels`, probability is 1. Other columns of
    `docs` are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            c, failed, p, kept = _judged(data, offsets, model.value, threshold)
            numbers = [pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *numbers, pa.array(failed), pa.array(kept), pa.array(p)], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            yield rows.filter(pa.array(_judged(data, offsets, model.value, threshold)[3]))

    return docs.mapInArrow(kept_rows, docs.schema)
