"""A stored index of vectors by cells: top-k by cosine that reads few full vectors and is exact unless asked not to be.

Vectors at unit length lie in the cell of their nearest centre, in blocks by their angle to it. A block holds them in one byte an entry, with how far
each is from its own rounding. A query first scans the nearest cells; by the triangle inequality of angles no other block can hold one of its k
best once its bound falls below the k-th best so far. What rounding leaves open is settled by the full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textquarry.operators.vector_blocks import BROADCAST, best_of, one_list, rows_of, units_of
from textquarry.sources.shared import stored

MOST_CELLS, FIT_ROWS, ROUNDS = 1024, 64, 6
_SLACK = 1e-9


@dataclass(frozen=True)
class CellIndex:
    """Tables in a folder, and what is small: centres, and each cell's smallest and largest angle."""

    spark: SparkSession
    folder: str
    key: str
    centres: np.ndarray
    angles: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows_of(dim)):
            some = batch.slice(at, rows_of(dim))
            yield some, units_of(some.column("v"), dim)


def _units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and forall(v, x -> x is not null and not isnan(x)) and exists(v, x -> x <> 0)")


def _fitted(rows: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres moved to the direction of the sum of their vectors, `rounds` times; sums are made in each partition and added up by cell."""
    dim = centres.shape[1]
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(now.shape)
            for _, x in _matrices(batches, dim):
                np.add.at(total, np.argmax(x @ now.T, axis=1), x)
            some = np.flatnonzero(total.any(axis=1))
            flat = pa.array(total[some].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), flat)], ["cell", "s"])

        def added(table: pa.Table) -> pa.Table:
            total = np.asarray(table.column("s").combine_chunks().flatten()).reshape(-1, dim).sum(axis=0)
            return pa.table({"cell": table.column("cell").slice(0, 1), "s": one_list(pa.array(total))})

        found = rows.mapInArrow(sums, "cell int, s array<double>").groupBy("cell").applyInArrow(added, "cell int, s array<double>").toArrow()
        moved = np.asarray(found.column("s").combine_chunks().flatten()).reshape(-1, dim)
        length = np.sqrt((moved * moved).sum(axis=1))
        centres = now.copy()
        ok = length > _SLACK
        centres[np.asarray(found.column("cell"))[ok]] = moved[ok] / length[ok, None]
    return centres


def build(vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> CellIndex:
    """Writes the index of `vectors` to `folder` and opens it.

    About the square root of the number of rows in cells, MOST_CELLS at most, unless `cells` says; centres are fitted on about `fit_rows` rows a cell,
    picked by a hash of their key; every row is indexed. Rows with a null key, or whose vector is null, zero, has missing numbers or another length
    than the most frequent one, are left out, as they have no cosine.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = _units(vectors, key, vector)
    usual = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (usual["dim"], usual["n"]) if usual else (0, 0)
    rows = rows.where(F.size("v") == dim)
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n)) if n else 0
    first = rows.orderBy(F.xxhash64("k")).limit(cells).select("v").toArrow().column("v").combine_chunks()
    every = max(1, n // max(1, fit_rows * cells))
    centres = units_of(first, dim)
    if n:
        centres = _fitted(rows.where(F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(every)) == 0), centres, rounds)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, dim):
            cosines = x @ centres.T
            cell = np.argmax(cosines, axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(x)), cell], -1, 1))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), unit, pa.array(cell.astype(np.int32)), pa.array(angle)], ["k", "v", "cell", "angle"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)) if len(cell) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(s, e, rows_of(dim)):
                    some = batch.slice(at, min(e - at, rows_of(dim)))
                    x = np.asarray(some.column("v").flatten()).reshape(-1, dim)
                    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
                    code = np.rint(x / scale[:, None]).astype(np.int8)
                    off = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))
                    angle = np.asarray(some.column("angle"))
                    made = {"cell": pa.array([cell[at]], pa.int32()), "ids": one_list(some.column("k")), "codes": pa.array([code.tobytes()], pa.binary()), "near": [angle.min()], "far": [angle.max()]}
                    yield pa.RecordBatch.from_pydict(made | {"scales": pa.array([scale.tobytes()], pa.binary()), "off": pa.array([off.tobytes()], pa.binary())})

    placed = rows.mapInArrow(assigned, f"k {kind}, v array<double>, cell int, angle double") if n else spark.createDataFrame([], f"k {kind}, v array<double>, cell int, angle double")
    placed.select("k", "v", "cell", "angle").write.mode("overwrite").parquet(f"{folder}/vectors")
    ordered = spark.read.parquet(f"{folder}/vectors").repartitionByRange("cell", "angle", "k").sortWithinPartitions("cell", "angle", "k")
    packed = ordered.mapInArrow(blocks, f"cell int, ids array<{kind}>, codes binary, near double, far double, scales binary, off binary")
    packed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/blocks")
    spread = spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"))
    small = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    small.join(F.broadcast(spread), "cell").select("cell", "centre", "near", "far", F.lit(key).alias("key")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return opened(spark, folder, key)


def opened(spark: SparkSession, folder: str, key: str = "vec_id") -> CellIndex:
    """An index that `build` wrote. Cells without vectors are no cells."""
    small = spark.read.parquet(f"{folder}/centres").orderBy("cell").toArrow()
    m = small.num_rows
    centres = np.asarray(small.column("centre").combine_chunks().flatten()).reshape(m, -1) if m else np.zeros((0, 0))
    return CellIndex(spark, folder, key, centres, np.stack([np.asarray(small.column(c)) for c in ("cell", "near", "far")], axis=1) if m else np.zeros((0, 3)))


def _reach(theta: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Highest cosine that angles from `near` to `far` to a centre allow with what is at angle `theta` to it."""
    return np.cos(np.maximum(0, np.maximum(theta - far, near - theta)))


def _asked(index: CellIndex, queries: DataFrame, kind: str, probes: int, rest: bool) -> DataFrame:
    """(q, v, floor, cell, theta) of each query (q, v, floor) and the nearest `probes` cells, or those of the `rest` that may reach the floor."""
    centres, numbers, near, far = index.centres, index.angles[:, 0].astype(np.int32), index.angles[:, 1], index.angles[:, 2]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, centres.shape[1]):
            theta = np.arccos(np.clip(x @ centres.T, -1, 1))
            order = np.argsort(theta, axis=1, kind="stable")
            chosen = np.zeros(theta.shape, bool)
            np.put_along_axis(chosen, order[:, :probes], True, axis=1)
            if rest:
                chosen = ~chosen & (_reach(theta, near, far) >= np.asarray(batch.column("floor"))[:, None] - _SLACK)
            r, c = np.nonzero(chosen)
            at = pa.array(r)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[r].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("q").take(at), unit, batch.column("floor").take(at), pa.array(numbers[c]), pa.array(theta[r, c])], ["q", "v", "floor", "cell", "theta"])

    return queries.mapInArrow(part, f"q {kind}, v array<double>, floor double, cell int, theta double")


def _scanned(index: CellIndex, asked: DataFrame, q_kind: str, kind: str, k: int, digits: int, n: int) -> DataFrame:
    """(q, k, low, high): bounds of the cosines of the pairs that may be among a query's k best, by the bytes of the asked cells' blocks."""
    dim = index.centres.shape[1]
    chunks = max(1, -(-n // 2048))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        v = np.asarray(table.column("v").combine_chunks().flatten())
        columns = {"cell": pa.array([key[0].as_py()], pa.int32()), "q": one_list(table.column("q").combine_chunks()), "qm": pa.array([v.tobytes()], pa.binary())}
        return pa.table(columns | {c: pa.array([np.asarray(table.column(c)).tobytes()], pa.binary()) for c in ("theta", "floor")})

    packs = asked.groupBy("cell", F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("chunk")).applyInArrow(pack, f"cell int, q array<{q_kind}>, qm binary, theta binary, floor binary")
    packs = stored(packs)
    wanted = [r[0] for r in packs.select("cell").distinct().collect()]  # cells at most
    size = packs.agg(F.sum(F.octet_length("qm"))).first()[0] or 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: E731, B023
                theta, floor = of("theta", np.float64), of("floor", np.float64)
                able = _reach(theta, batch.column("near")[i].as_py(), batch.column("far")[i].as_py()) >= floor - _SLACK
                if not able.any():
                    continue
                x = of("codes", np.int8).reshape(-1, dim) * of("scales", np.float64)[:, None]
                off = of("off", np.float64)[:, None] + _SLACK
                sims = x @ of("qm", np.float64).reshape(-1, dim)[able].T
                low, high = sims - off, sims + off
                rounded = 10.0**-digits
                keep = high >= floor[able] - rounded
                if k < len(low):
                    keep &= high >= np.partition(low, len(low) - k, axis=0)[len(low) - k] - rounded
                r, c = np.nonzero(keep)
                q = batch.column("q")[i].values.filter(pa.array(able)).take(pa.array(c))
                yield pa.RecordBatch.from_arrays([q, batch.column("ids")[i].values.take(pa.array(r)), pa.array(low[r, c]), pa.array(high[r, c])], ["q", "k", "low", "high"])

    blocks = index.blocks.where(F.col("cell").isin(wanted))
    met = blocks.join(F.broadcast(packs) if size <= BROADCAST else packs, "cell").select("ids", "codes", "near", "far", "scales", "off", "q", "qm", "theta", "floor")
    return met.mapInArrow(scan, f"q {q_kind}, k {kind}, low double, high double")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """(q, floor): the k-th best lower bound of each query, if it has k."""
    top = found.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("i") <= k)
    return top.groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).otherwise(-2.0).alias("floor"))


def candidates(index: CellIndex, queries: DataFrame, k: int, query_key: str = "query_id", vector: str = "embedding", probes: int = 8, safe: bool = True, digits: int = 7) -> DataFrame:
    """(q, k, low, high) of the pairs whose full vectors have to be read; stored."""
    kind, q_kind = index.vectors.schema["k"].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    asked = _units(queries.select(query_key, vector), query_key, vector).where(F.size("v") == index.centres.shape[1]).withColumnRenamed("k", "q")
    n = asked.count()
    if not n or not len(index.centres):
        return index.spark.createDataFrame([], f"q {q_kind}, k {kind}, low double, high double")
    nearest = _asked(index, asked.withColumn("floor", F.lit(-2.0)), q_kind, probes, False)
    found = stored(_scanned(index, nearest, q_kind, kind, k, digits, n))
    if safe:
        floors = asked.join(_floors(found, k), "q", "left").select("q", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        found = stored(found.union(_scanned(index, _asked(index, floors, q_kind, probes, True), q_kind, kind, k, digits, n)))
    return stored(found.join(_floors(found, k), "q").where(F.col("high") >= F.col("floor") - 10.0**-digits).drop("floor"))


def search(index: CellIndex, queries: DataFrame, k: int, query_key: str = "query_id", vector: str = "embedding", probes: int = 8, safe: bool = True, digits: int = 7) -> DataFrame:
    """(query_key, key, cosine, rank): the k nearest vectors of each query, ties at `digits` decimals by key.

    If `safe`, all others are proved to be further away; else only the nearest `probes` cells are searched. Query keys are unique; queries without a whole vector of
    the index's length have no rows. The cosines are those of the full vectors.
    """
    pairs = candidates(index, queries, k, query_key, vector, probes, safe, digits).select("q", "k")
    asked = _units(queries.select(query_key, vector), query_key, vector).select(F.col("k").alias("q"), F.col("v").alias("qv"))
    full = pairs.join(index.vectors.select("k", "v"), "k").join(asked, "q")
    scored = full.select(F.col("q").alias(query_key), F.col("k").alias(index.key), (_dot("v", "qv") / F.sqrt(_dot("qv", "qv"))).alias("cosine"))
    order = Window.partitionBy(query_key).orderBy(F.round("cosine", digits).desc(), F.col(index.key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
