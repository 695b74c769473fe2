"""Embedding near-dedup: small-world graphs per shard, every shard queried, beams widened until recall audits pass, links verified, components.

Equal vectors are one representative with a count. A label's representatives are dealt to shards of at most about SHARD_ROWS; each shard's graph
is built in one task and asked for the neighbours of its own vectors; where a label has several shards, the graphs are written and each
two of its shards are asked for each other's vectors. A query whose beam is full of hits is compared with the whole shard. Hits are bits of one
matrix for each two shards, counted there, and leave only an edge to their component, so that large groups never become lists of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textquarry.llm.components import components
from textquarry.llm.scratch import stored
from textquarry.llm.small_world import SmallWorld, levels_of
from textquarry.llm.words import mixed

THRESHOLD = 0.93
SHARD_ROWS = 32768
#: Most queries whose hits are one block of booleans.
QUERY_ROWS = 512
BEAM = 48
#: Queries of each shard (the first by hash) whose hits are compared with all of the shard, and the share that has to be found.
AUDIT_ROWS = 512
RECALL = 0.99
_LINKED = 64
_BLOCK = 64
#: kind 0: a vector, its component inside the shard, its links there; 1: links to another shard; 2: a shard's graph; 3: an audit's links (n) and
#: how many of them were found (other).
_OUT = ["kind", "vec", "other", "n", "label", "dim", "shard", "graph"]
_OUT_TYPES = "kind int, vec long, other long, n long, label int, dim int, shard int, graph binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(n, -1)


class _Search:
    """Hits of queries among a shard's vectors, at a beam width that has passed the audit."""

    def __init__(self, graph: SmallWorld, exact: np.ndarray, threshold: float, query_rows: int = QUERY_ROWS):
        self.graph, self.exact, self.threshold = graph, exact, threshold
        self.step = max(16, min(query_rows, (1 << 24) // max(len(exact), 1)) // 8 * 8)

    def hits(self, q: np.ndarray, own: np.ndarray | None, width: int) -> np.ndarray:
        """A row of booleans over the shard for each query (at most `step`), cosine verified in double precision.

        A query whose beam is full of hits, and every query once beams would hold a quarter of the shard, is compared with the whole shard.
        """
        n = len(self.exact)
        out, full = np.zeros((len(q), n), bool), np.ones(len(q), bool)
        if 4 * width < n:
            ids, sims = self.graph.search(q.astype(np.float32), width, own)
            near = (ids >= 0) & (sims >= self.threshold - 1e-4)
            full = near.all(axis=1)
            r, c = np.nonzero(near & ~full[:, None])
            found = ids[r, c]
            good = np.einsum("ed,ed->e", q[r], self.exact[found]) >= self.threshold
            out[r[good], found[good]] = True
        out[full] = q[full] @ self.exact.T >= self.threshold
        if own is not None:
            out[np.arange(len(q)), own] = False
        return out

    def audited(self, q: np.ndarray, own: np.ndarray | None, order: np.ndarray, width: int, rows: int, recall: float) -> tuple[int, np.ndarray]:
        """The narrowest tried width that finds `recall` of what brute force finds for the audit's queries, and (links there are, links found).

        Queries are held to it by size class (hits of 1, 2 to 3, 4 to 7 and so on), so that a large group doesn't hide what those with few lose.
        More than `rows` queries are audited until _LINKED of them have a link. Beams of a quarter of the shard are brute force and pass.
        """
        sample, true, linked = [], [], 0
        for at in range(0, len(order), _BLOCK):
            if at >= rows and linked >= _LINKED:
                break
            some = order[at : at + _BLOCK]
            c = q[some] @ self.exact.T >= self.threshold
            if own is not None:
                c[np.arange(len(some)), own[some]] = False
            n = c.sum(axis=1)
            sample.append(some[n > 0])
            true.append(n[n > 0])
            linked += int((n > 0).sum())
        sample, true = np.concatenate(sample), np.concatenate(true)
        sizes = np.log2(true).astype(np.int64)
        while len(sample):
            parts = (sample[at : at + self.step] for at in range(0, len(sample), self.step))
            found = np.concatenate([self.hits(q[x], own[x] if own is not None else None, width).sum(axis=1) for x in parts])
            if (np.bincount(sizes, weights=found) >= recall * np.bincount(sizes, weights=true)).all():
                return width, np.array([true.sum(), found.sum()])
            width *= 2
        return width, np.zeros(2, np.int64)


class _Bits:
    """Links between rows and columns as one packed matrix; a link that only one end found is a link."""

    def __init__(self, rows: int, columns: int):
        self.columns = columns
        self.packed = np.zeros((rows, -(-columns // 8)), np.uint8)

    def add(self, at: int, hit: np.ndarray) -> None:
        self.packed[at : at + len(hit)] |= np.packbits(hit, axis=1)

    def add_back(self, at: int, hit: np.ndarray) -> None:
        """hit: a row for each column from `at` on, which is a multiple of eight."""
        self.packed[:, at // 8 : at // 8 + -(-len(hit) // 8)] |= np.packbits(hit.T, axis=1)

    def rows(self, at: int, to: int) -> np.ndarray:
        return np.unpackbits(self.packed[at:to], axis=1, count=self.columns)

    def roots(self) -> np.ndarray:
        """Smallest index of each index's component, for a square matrix: breadth first, each row is read once."""
        root, left = np.arange(len(self.packed)), self.packed.any(axis=1)
        for first in np.flatnonzero(left):
            new = np.array([first] if left[first] else [], np.int64)
            left[new] = False
            while len(new):
                reached = np.zeros(self.packed.shape[1], np.uint8)
                for at in range(0, len(new), QUERY_ROWS):
                    reached |= np.bitwise_or.reduce(self.packed[new[at : at + QUERY_ROWS]], axis=0)
                new = np.flatnonzero(np.unpackbits(reached, count=self.columns) & left)
                root[new], left[new] = first, False
        return root


def _table(kind: int, vec: np.ndarray, other: np.ndarray, n: np.ndarray, label: int, dim: int, shard: int, graph: bytes | None = None) -> pa.Table:
    m = len(vec)
    same = lambda x: pa.array(np.full(m, x, np.int32))
    columns = [same(kind), pa.array(vec.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(n.astype(np.int64)), same(label), same(dim), same(shard), pa.array([graph] * m, pa.binary())]
    return pa.Table.from_arrays(columns, _OUT)


def link(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = BEAM, audit_rows: int = AUDIT_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least `threshold`. Vectors
    that are null, empty, zero or hold null or non-finite numbers, those of other dimension, and rows with a null id link with nothing (n_links
    0, component_id their id). Repeated rows are vectors of their own. Every reported link is verified; the share found is held to `recall` by
    audits. Other columns are ignored.
    """
    ok = F.expr("label is not null and vec_id is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(x, v -> v <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("dim", F.size("x")).withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(7), "x"))
    key = ["label", "dim", "h1", "h2"]
    reps = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("vec"), F.count("*").alias("m"), F.first("x").alias("x"))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("of"))
    reps = stored(reps.join(sizes, ["label", "dim"]).withColumn("shards", F.ceil(F.col("of") / shard_rows).cast("int")).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int")).drop("of"))

    def own(key: tuple, table: pa.Table) -> pa.Table:
        label, dim, shard, shards = (k.as_py() for k in key)
        order = np.argsort(np.asarray(table.column("vec")))
        vec, weight = np.asarray(table.column("vec"))[order], np.asarray(table.column("m"))[order]
        exact = _unit(_matrix(table.column("x"), len(vec))[order])
        hashes = mixed(vec.view(np.uint64))
        graph = SmallWorld(exact.astype(np.float32), levels_of(hashes))
        me, search = np.arange(len(vec)), _Search(graph, exact, threshold, query_rows)
        width, audit = search.audited(exact, me, np.argsort(hashes), beam, audit_rows, recall)
        bits = _Bits(len(vec), len(vec))
        for at in range(0, len(vec), search.step):
            hit = search.hits(exact[at : at + search.step], me[at : at + search.step], width)
            bits.add(at, hit)
            bits.add_back(at, hit)
        counts = np.concatenate([bits.rows(at, at + _BLOCK) @ weight for at in range(0, len(vec), _BLOCK)])
        out = [_table(0, vec, vec[bits.roots()], counts, label, dim, shard), _table(3, vec[:1], audit[1:], audit[:1], label, dim, shard)]
        if shards > 1:
            out.append(_table(2, vec[:1], vec[:1], np.zeros(1), label, dim, shard, graph.dumped()))
        return pa.concat_tables(out)

    found = stored(reps.groupBy("label", "dim", "shard", "shards").applyInArrow(own, _OUT_TYPES))
    results = found.where("kind = 0").select("vec", "other", "n")
    several = reps.where("shards > 1")
    if not several.isEmpty():
        pairs = lambda x: x.withColumn("far", F.explode(F.expr("filter(sequence(0, shards - 1), s -> s <> shard)"))).withColumn("low", F.least("shard", "far")).withColumn("high", F.greatest("shard", "far"))
        shards = several.select("label", "dim", "shard", "shards").distinct()
        columns = ["label", "dim", "low", "high", "shard", "graph", "vec", "m", "root", "x"]
        members = several.join(found.where("kind = 0").select("vec", F.col("other").alias("root")), "vec").withColumn("graph", F.lit(None).cast("binary"))
        graphs = found.where("kind = 2").select("label", "dim", "shard", "graph").join(shards, ["label", "dim", "shard"])
        graphs = graphs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("vec", "m", "root")], F.lit(None).cast("array<double>").alias("x"))
        asked = pairs(members).select(*columns).union(pairs(graphs).select(*columns))

        def across(key: tuple, table: pa.Table) -> pa.Table:
            """Links between two shards: each is asked for the other's vectors, and what either finds is a bit of one matrix."""
            sides = []
            for shard in (key[2], key[3]):
                mine = table.filter(pc.equal(table.column("shard"), shard))
                graph = SmallWorld.loaded(next(x for x in mine.column("graph").to_pylist() if x is not None))
                mine = mine.filter(pc.is_valid(mine.column("vec")))
                order = np.argsort(np.asarray(mine.column("vec")))
                vec, weight, root = (np.asarray(mine.column(c))[order] for c in ("vec", "m", "root"))
                sides.append((vec, weight, root, _Search(graph, _unit(_matrix(mine.column("x"), len(vec))[order]), threshold, query_rows)))
            (vec, weight, root, one), (far, far_weight, far_root, two) = sides
            bits = _Bits(len(vec), len(far))
            for ids, asking, asked_of, add in ((vec, one, two, bits.add), (far, two, one, bits.add_back)):
                width, _ = asked_of.audited(asking.exact, None, np.argsort(mixed(ids.view(np.uint64))), beam, audit_rows, recall)
                for at in range(0, len(ids), asked_of.step):
                    add(at, asked_of.hits(asking.exact[at : at + asked_of.step], None, width))
            by_root = np.argsort(far_root, kind="stable")
            roots, begins = np.unique(far_root[by_root], return_index=True)
            n, far_n, edges = [], np.zeros(len(far)), [np.zeros((0, 2), np.int64)]
            for at in range(0, len(vec), _BLOCK):
                hit = bits.rows(at, at + _BLOCK)
                n.append(hit @ far_weight)
                far_n += weight[at : at + _BLOCK] @ hit
                r, c = np.nonzero(np.maximum.reduceat(hit[:, by_root], begins, axis=1))
                edges.append(np.unique(np.stack([root[at + r], roots[c]], 1), axis=0))
            edges = np.unique(np.concatenate(edges), axis=0)
            counted = [_table(1, ids, ids, counts, 0, 0, 0) for ids, counts in ((vec, np.concatenate(n)), (far, far_n))]
            return pa.concat_tables([*counted, _table(1, edges[:, 0], edges[:, 1], np.zeros(len(edges)), 0, 0, 0)])

        far = asked.groupBy("label", "dim", "low", "high").applyInArrow(across, _OUT_TYPES)
        results = stored(results.union(far.select("vec", "other", "n")))
    roots = components(results.where("vec <> other").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    counts = results.groupBy("vec").agg(F.sum("n").alias("n"))
    per = reps.select(*key, "vec", "m").join(counts, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    per = per.select(*key, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component"))
    linkable = rows.where("ok").drop("x").join(per, key).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one(vectors: DataFrame, **options: float) -> DataFrame:
    """The rows of `vectors`, all columns, that are their component's smallest id."""
    stay = link(vectors, **options).where("kept").select(F.col("vec_id").alias("stay")).distinct()
    return vectors.join(stay, vectors["vec_id"].eqNullSafe(stay["stay"]), "left_semi")


