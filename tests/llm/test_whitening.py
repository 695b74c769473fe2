import math

import numpy as np
import pytest

from textquarry.llm import whitening
from textquarry.llm.eigen import WIDE, clusters, eigenvectors


def spectrum(values, seed=3):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(WIDE)
    for _ in range(4):  # orthogonal beyond doubles
        q = q @ (WIDE(1.5) * np.eye(len(values)) - (q.T @ q) / 2)
    a = q @ np.diag(np.array(values, WIDE)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        [9, 5, 3, 1], [7, 7, 7, 2, 1], [1 + 1e-9 * i for i in range(12)], [4, 4 + 1e-13, 4 + 2e-13, 1, 1, 0], [1e6, 1e3, 3.0, 3.0 + 1e-7, 1e-6], [0.0, 0.0], list(range(1, 41)),
    ],
)
def test_eigenvectors_solve_to_double_precision(values):
    a, _ = spectrum(values)
    found, x = eigenvectors(a)
    top = max(np.abs(values)) or 1
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-16 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * found).max() <= 1e-16 * top


def test_single_eigenvectors_among_close_ones():
    values = [5, 1 + 2e-9, 1 + 1e-9, 1, 0.5]
    a, q = spectrum(values)
    _, x = eigenvectors(a)
    assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-18
    assert np.abs(np.abs(q.T @ x) - np.eye(5)).max() < 1e-9


def test_clusters_chain_neighbours():
    assert [sorted(c.tolist()) for c in clusters(np.array([1.0, 5.0, 1.05, 1.1, 9.0, 5.01]), 0.06)] == [[0, 2, 3], [1, 5]]


def plain(vectors, most=16):
    """Whitening by a full eigendecomposition of exact covariances."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s) / n).astype(np.float64)
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    k = min(most, int((values > 1e-9 * values.sum()).sum()))
    return n, [sum(int(c) ** 2 for c in n * row - s) for row in x], ((n * x - s) / n).astype(np.float64) @ q[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id long, embedding array<float>, x string, component int").repartition(3)


def check(df, ids, vectors, most=16):
    n, deviation, white, explained = plain(vectors, most)
    got = {}
    for r in df.collect():
        assert (r["vec_id"], r["component"]) not in got
        got[r["vec_id"], r["component"]] = r
    k = white.shape[1]
    assert set(got) == {(i, c) for i in ids for c in range(1, k + 1)}
    mine = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-8
    for i, d in zip(ids, deviation, strict=True):
        for c in range(k):
            r = got[i, c + 1]
            assert r["n"] == n and r["deviation"] == d and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-12
    assert len({r["identity_error"] for r in got.values()}) == 1


def test_whitening_equals_plain_one(spark):
    rng = np.random.default_rng(5)
    made = (rng.normal(size=(300, 24)) * np.linspace(3, 0.3, 24)).astype(np.float32).tolist()
    made += made[:100] + [made[0]] * 200
    bad = [None, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0] * 5, []]
    rows = list(enumerate(made)) + [(10_000 + i, v) for i, v in enumerate(bad)]
    check(whitening.whiten(table(spark, rows)), list(range(len(made))), made)
    check(whitening.whiten(table(spark, rows), components=3), list(range(len(made))), made, 3)


def test_fewer_directions_and_few_rows(spark):
    flat = [[float(i), 2.0 * i, 5.0] for i in (-2, 0, 1, 4)]
    check(whitening.whiten(table(spark, list(enumerate(flat)))), list(range(4)), flat)
    one = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got if r["component"] == 1) == [(False, 3), (False, 3), (False, 4), (True, 0)] and {r["n"] for r in got} == {3}


def test_large_entries_do_not_overflow(spark):
    rows = [(i, [1e30 if i == 3 else float(i), 1e9 * i]) for i in range(5)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == set(range(5)) and all(r["deviation"] is None for r in got if r["vec_id"] == 3)
