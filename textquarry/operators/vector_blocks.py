"""Cosines of many queries against many vectors as a grid of blocks: a block of vectors meets a block of queries in one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows of a block, and bytes of its matrix, at most.
ROWS, BYTES = 4096, 1 << 20
#: Query blocks of at most so many bytes in all are broadcast; beyond that blocks of vectors are shuffled to them.
BROADCAST = 32 << 20


def units_of(column: pa.Array, dimension: int, smallest: float = 1e-10) -> np.ndarray:
    """Rows at unit length; those of another dimension or with missing numbers are not numbers."""
    same = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False))
    out = np.full((len(column), dimension), np.nan)
    flat = pc.list_flatten(column.filter(pa.array(same))).to_numpy(zero_copy_only=False).astype(np.float64)
    out[same] = flat.reshape(-1, dimension) if dimension else 0
    return out / (np.sqrt((out * out).sum(axis=1, keepdims=True)) + smallest)


def one_list(values: pa.Array) -> pa.Array:
    """An array of one row that lists the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def rows_of(dimension: int) -> int:
    return max(1, min(ROWS, BYTES // (8 * max(dimension, 1))))


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, ids, m): blocks of the unit vectors of one length, packed where they are read; rows without a whole vector are left out."""
    kind = vectors.schema[key].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[~np.isnan(lengths.astype(float))]).astype(int):
                for at in range(0, batch.num_rows, rows_of(dim)):
                    some = batch.slice(at, rows_of(dim))
                    m = units_of(some.column("v"), dim)
                    whole = ~np.isnan(m).any(axis=1)
                    if whole.any():
                        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": one_list(some.column("k").filter(pa.array(whole))), "m": pa.array([m[whole].tobytes()], pa.binary())})

    return vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(part, f"dim int, ids array<{kind}>, m binary")


def query_blocks(queries: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, int, int]:
    """((block, dim, q_ids, q), number of blocks, bytes of all of them): queries dealt to blocks of about `block` by a hash of their key."""
    asked = queries.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, kind = max(1, -(-n // block)), queries.schema[key].dataType.simpleString()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        m = units_of(table.column("v").combine_chunks(), key[1].as_py())
        whole = ~np.isnan(m).any(axis=1)
        ids = table.column("k").combine_chunks().filter(pa.array(whole))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "q_ids": one_list(ids), "q": pa.array([m[whole].tobytes()], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).groupBy("block", F.size("v").alias("dim"))
    return dealt.applyInArrow(pack, f"block int, dim int, q_ids array<{kind}>, q binary"), blocks, 8 * n * (dim or 0)


def best_of(scores: np.ndarray, k: int | None, digits: int) -> np.ndarray:
    """Which of scores (rows: vectors, columns: queries) may be among the k best of a query: those at or above its k-th best at `digits` decimals."""
    if k is None or k >= len(scores):
        return np.ones(scores.shape, bool)
    rounded = np.round(scores, digits)
    return rounded >= np.partition(rounded, len(rounded) - k, axis=0)[len(rounded) - k]


def cosine_scores(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", most_queries: int | None = None, block: int = 2048, k: int | None = None, digits: int = 9
) -> DataFrame:
    """(query_key, key, cosine) of every query against every vector of its length; more than `most_queries` are refused if it is given.

    The grid has a cell for each block of vectors and each block of about `block` queries. With `k` a cell leaves out what is below its own k-th best
    cosine (at `digits` decimals) of a query, which cannot be among the k best of all; `nearest` then merges the cells. Rows whose vector is null or
    has missing numbers, and queries with a null key, are left out.
    """
    if most_queries is not None and queries.count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    asked, blocks, size = query_blocks(queries, query_key, vector, block)
    cells = packed(vectors, key, vector).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.join(F.broadcast(asked) if size <= BROADCAST else asked, ["block", "dim"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, q_ids = batch.column("ids")[i].values, batch.column("q_ids")[i].values
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("m", "q"))
                sims = x @ q.T
                r, c = np.nonzero(best_of(sims, k, digits))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(c)), ids.take(pa.array(r)), pa.array(sims[r, c])], [query_key, key, "cosine"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (vectors, key))]
    return cells.select("dim", "ids", "m", "q_ids", "q").mapInArrow(scored, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, cosine double")
