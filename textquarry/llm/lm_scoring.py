"""LM scoring of documents: a context-mixing model learnt from the training documents' counts, beside word unigrams of the same documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm import context_mixing as cm
from textquarry.llm.scratch import stored
from textquarry.llm.words import LOWER, slices, span_hashes, spans

#: Tokens with at least this share of all training tokens (so at most 1 / SHARE of them) are broadcast; the others are joined.
SHARE = 2e-6
#: Slots of each hashed context: about one for 16 training bytes, between 2^22 and 2^23 of them.
BITS = (22, 23)
_BLOCK = 1 << 15
#: Tasks whose counts of one block of slots are added up first.
AT_ONCE = 64
_END_TOKEN = -1  # stands for the end in the tables of token hashes


def _rest(doc_id: Column, mod: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the lower-cased words."""
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets)
    return rows, span_hashes(data, starts, ends).view(np.int64)


def _token_counts(train: DataFrame) -> DataFrame:
    """(kind, key, c) over the training documents: tokens (kind 0, the end as _END_TOKEN), and lower-cased bytes after bytes (kind 1, key 256 * before
    + byte; beyond both ends stands 0xFF)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_, ends = np.zeros(1 << 16, np.int64), 0
        keys, counts, n = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, which = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(which, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)

        for rows, data, offsets in slices(batches, "text"):
            k, c = np.unique(_tokens(data, offsets)[1], return_counts=True)
            keys.append(k)
            counts.append(c)
            n += len(k)
            ends += rows.num_rows
            text = LOWER[np.insert(data, offsets, cm.END)]  # a mark before each text and after the last
            bytes_ += np.bincount(text[:-1].astype(np.int64) * 256 + text[1:], minlength=1 << 16)
            if n > 1 << 21:
                k, c = merged()
                if len(k) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int32)), pa.array(k), pa.array(c)], ["kind", "key", "c"])
                    k, c = k[:0], c[:0]
                keys, counts, n = [k], [c], len(k)
        if ends:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k) + 1, np.int32)), pa.array(np.append(k, _END_TOKEN)), pa.array(np.append(c, ends))], ["kind", "key", "c"])
            code = np.flatnonzero(bytes_)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(code), np.int32)), pa.array(code), pa.array(bytes_[code])], ["kind", "key", "c"])

    return train.select("text").mapInArrow(part, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")).where("c > 0")


def _packed(counts: np.ndarray) -> bytes:
    """Compressed by byte planes, of which the upper ones are nearly empty."""
    return pa.compress(counts.view(np.uint8).reshape(-1, counts.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, 2 * _BLOCK * width, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    out = planes[0].astype(kind)
    for j in range(1, width):
        if planes[j].any():
            out |= planes[j].astype(kind) << kind(8 * j)
    return out


def _model(train: DataFrame, tree, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds of every slot over all training documents, and the mixing weights.

    One pass: each partition learns counts and weights online from its share. Counts are added up in blocks of slots, weights averaged by decisions.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = cm.Learner(bits)
        for _, data, offsets, lead, last in cm.windows(batches, cm.LEARN_BYTES):
            learner.add(cm.decisions(data, offsets, tree.value, bits, lead, last))
        if learner.n:
            for i, counts in enumerate(learner.counts):
                for at in range(0, len(counts), _BLOCK):
                    block = counts[at : at + _BLOCK]
                    if block.any():
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), pa.array([_packed(block.view(np.uint16))], pa.binary())], names)
            learnt = np.append(learner.weights.ravel().astype(np.float64) * learner.n, learner.n)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([learnt.tobytes()], pa.binary())], names)

    def added(kind: type):
        def add(blocks: pa.Table) -> pa.Table:
            i, found = blocks.column("i")[:1], blocks.column("data").to_pylist()
            if i[0].as_py() < 0:
                total = sum(np.frombuffer(x, np.float64) for x in found).tobytes()
            elif len(found) == 1 and kind is np.int64:
                total = found[0]
            else:
                total = np.zeros(2 * _BLOCK, np.int64)
                for x in found:
                    total += _unpacked(x, kind)
                total = _packed(total)
            return pa.table([i, blocks.column("at")[:1], pa.array([total], pa.binary())], names)

        return add

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x if i < 0 else cm.odds_of(_unpacked(x, np.int64).reshape(-1, 2)).tobytes() for i, x in zip(batch.column("i").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("at"), pa.array(out, pa.binary())], names)

    names, schema = ["i", "at", "data"], "i int, at long, data binary"
    # some tasks' blocks at a time, then what they add up to
    counts = train.select("text").mapInArrow(part, schema).withColumn("some", F.floor(F.spark_partition_id() / AT_ONCE))
    first = counts.groupBy("i", "at", "some").applyInArrow(added(np.uint16), schema)
    second = first.groupBy("i", "at").applyInArrow(added(np.int64), schema).mapInArrow(odds, schema)
    tables = [np.zeros(1 << cm.slot_bits(k, bits), np.int8) for k in cm.ORDERS]
    weights = cm.first_weights()
    for i, at, data in second.toLocalIterator():
        if i < 0:
            v = np.frombuffer(data, np.float64)
            weights = (v[:-1] / v[-1]).reshape(cm.GATES, cm.INPUTS).astype(np.float32)
        else:
            tables[i][at : at + _BLOCK] = np.frombuffer(data, np.int8)
    return tables, weights


def _frequent(tokens: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = tokens.where(F.col("c") >= max(1.0, SHARE * n)).select("key", "c").toArrow()
    keys, c = np.asarray(got.column("key").combine_chunks()), np.asarray(got.column("c").combine_chunks())
    order = np.argsort(keys)
    return keys[order], c[order]


def _looked_up(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Training count of each hash, 0 if it isn't among the frequent."""
    keys, c = frequent
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, c[at], 0)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Documents whose crc32(doc_id as text) mod 5 is not 1 are learnt from. score is the model's log10 probability of the lower-cased text and its
    end; base_score is that of its words and end under unigrams. A null text counts as empty (one token, the end); a null id counts as the id
    "" for the division; repeated rows count as often as they occur, and each gets its row. Without training documents every decision is even.
    Other columns of `docs` are ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    train = docs.where(_rest(F.col("doc_id"), 5) != 1)
    counted = stored(_token_counts(train))
    tokens = counted.where("kind = 0")
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    of_bytes = np.zeros(1 << 16, np.int64)
    pairs = counted.where("kind = 1").select("key", "c").toArrow()
    of_bytes[pairs.column("key").to_numpy()] = pairs.column("c").to_numpy()
    tree = sc.broadcast(cm.tree_of(of_bytes.reshape(256, 256)))
    bits = min(max((int(of_bytes.sum()) // 16).bit_length(), BITS[0]), BITS[1])
    model = sc.broadcast(_model(train, tree, bits))
    frequent = sc.broadcast(_frequent(tokens, n))
    end_count = tokens.where(F.col("key") == _END_TOKEN).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    floor = float(np.log10(n + 0.5 * (v + 1)))
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    names = ["row_key", "key", "n_tokens", "known", "common_sum"]

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each token that isn't frequent, and one for each text with what its frequent tokens and end add up to."""
        for rows, data, offsets in slices(batches, "text"):
            m = rows.num_rows
            row, h = _tokens(data, offsets)
            c = _looked_up(h, frequent.value)
            known = c > 0
            common = np.bincount(row[known], weights=np.log10(c[known] + 0.5), minlength=m) + np.log10(end_count + 0.5)
            n_known = np.bincount(row[known], minlength=m) + (end_count > 0)
            keys, left = rows.column("row_key"), np.flatnonzero(~known)
            yield pa.RecordBatch.from_arrays([keys, keys, pa.array(np.bincount(row, minlength=m) + 1), pa.array(n_known.astype(np.int64)), pa.array(common)], names)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[left])), pa.array(h[left]), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.float64())], names)

    found = keyed.select("row_key", "text").mapInArrow(tokens_of, "row_key long, key long, n_tokens long, known long, common_sum double")
    found = found.join(tokens.where(F.col("c") < max(1.0, SHARE * n)).select("key", "c"), "key", "left")
    of_token, m = F.col("n_tokens").isNull(), F.count("n_tokens")
    # rows of equal id and text share a key; their tokens are added up m times
    sums = found.groupBy("row_key").agg(
        (F.coalesce(F.sum(F.when(of_token, F.log10(F.coalesce("c", F.lit(0)) + 0.5))), F.lit(0.0)) / m + F.max("common_sum")).alias("log_sum"),
        (F.max("known") + (F.count(F.when(of_token, F.col("c"))) / m).cast("long")).alias("n_known"), F.max("n_tokens").alias("n_tokens"),
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, w = model.value
        whole: list[tuple[pa.RecordBatch, np.ndarray, cm.Evidence]] = []

        def row(rows: pa.RecordBatch, size: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column("row_key"), rows.column("doc_id"), pa.array(size), pa.array(value)], ["row_key", "doc_id", "n_bytes", "score"])

        def together() -> Iterator[pa.RecordBatch]:
            if whole:
                value, at = cm.log10_probabilities(cm.joined([e for _, _, e in whole]))[0], 0
                for rows, size, _ in whole:
                    yield row(rows, size, value[at : at + len(size)])
                    at += len(size)
                whole.clear()

        before, shift, size = 0.0, None, 0  # of a long text's windows so far
        for rows, data, offsets, lead, last in cm.windows(batches, cm.SCORE_BYTES):
            e, n = cm.evidence(cm.decisions(data, offsets, tree.value, bits, lead, last), tables, w), np.diff(offsets) - lead
            if last and not lead:
                whole.append((rows, n, e))
                if sum(int(n.sum()) for _, n, _ in whole) >= cm.TOGETHER:
                    yield from together()
                continue
            value, shift = cm.log10_probabilities(e, shift)
            before, size = before + value, size + n
            if last:
                yield row(rows, size, before)
                before, shift, size = 0.0, None, 0
        yield from together()

    rows = keyed.mapInArrow(scored, f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, score double")
    return rows.join(sums, "row_key").select(
        "doc_id",
        (_rest(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
