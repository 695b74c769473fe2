import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import cells, vector_blocks, vectors
from textquarry.sources.shared import new_path


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, k string").repartition(3)


def plain(rows, asked, k):
    """Each query's k nearest by all cosines."""
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and x == x for x in v) and any(v) and i is not None]
    ids, m = [i for i, _ in ok], np.stack([v / np.linalg.norm(v) for _, v in ok])
    out = set()
    for q in asked:
        v = dict(ok)[q]
        c = m @ (v / np.linalg.norm(v))
        best = sorted(range(len(ids)), key=lambda j: (-round(c[j], 7), ids[j]))[:k]
        out |= {(q, ids[j], n + 1) for n, j in enumerate(best)}
    return out


def found(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


def clustered(rng, n):
    middles = rng.normal(size=(6, 8)) * 3
    rows = [(i, (middles[rng.integers(6)] + rng.normal(size=8) * 0.4).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a hot vector
    return rows + [(9000, None), (9001, [0.0] * 8), (9002, [1.0, 2.0]), (9003, [float("nan")] * 8), (9004, [None] + [1.0] * 7), (None, [1.0] * 8), (9005, [])]


@pytest.mark.parametrize(("block", "limit"), [(2048, vector_blocks.BROADCAST), (13, vector_blocks.BROADCAST), (13, 0)])
def test_grid_equals_all_cosines(spark, monkeypatch, block, limit):
    monkeypatch.setattr(vector_blocks, "BROADCAST", limit)
    monkeypatch.setattr(vector_blocks, "ROWS", 37)
    rows = clustered(np.random.default_rng(1), 300)
    v = table(spark, rows)
    asked = v.where("vec_id % 10 = 0 and vec_id < 300").select(F.col("vec_id").alias("query_id"), "embedding")
    scores = vectors.cosine_scores(v, asked, k=5, block=block, digits=7)
    assert found(vectors.nearest(scores, 5, digits=7)) == plain(rows, range(0, 300, 10), 5)
    plan = scores._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells_prove_what_they_find(spark):
    rows = clustered(np.random.default_rng(2), 600)
    v = table(spark, rows)
    index = cells.build(v, new_path(spark, "cells"), cells=12)
    asked = v.where("vec_id % 20 = 0 and vec_id < 600").select(F.col("vec_id").alias("query_id"), "embedding")
    want = plain(rows, range(0, 600, 20), 5)
    assert found(cells.search(index, asked, 5, probes=1)) == want
    assert found(cells.search(cells.opened(spark, index.folder), asked, 5, probes=3)) == want
    rough = found(cells.search(index, asked, 5, probes=3, safe=False))
    assert len({x[:2] for x in rough} & {x[:2] for x in want}) >= 0.9 * len(want)
    assert index.vectors.count() == 640 and index.blocks.agg(F.sum(F.size("ids"))).first()[0] == 640
    assert cells.candidates(index, asked, 5, probes=1).count() < 0.1 * 640 * 30


def test_cells_on_given_vectors_read_few(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = cells.build(v, new_path(spark, "cells"))
    want = found(vectors.nearest(vectors.cosine_scores(v, asked, k=10, digits=7), 10, digits=7))
    assert found(cells.search(index, asked, 10)) == want and len(want) == 10 * asked.count()
    assert cells.candidates(index, asked, 10).count() < 0.1 * v.count() * asked.count()


def test_empty_index_and_queries(spark):
    v = table(spark, clustered(np.random.default_rng(3), 30))
    none = cells.build(v.limit(0), new_path(spark, "cells"))
    asked = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert cells.search(none, asked, 3).count() == 0
    index = cells.build(v, new_path(spark, "cells"), cells=500)
    assert cells.search(index, asked.limit(0), 3).count() == 0
    assert {r["vec_id"] for r in cells.search(index, asked, 1000).where("query_id = 0").collect()} == {*range(70)}
