import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import batches, latent, vectors

FILES = "project string, path string, size int"


def plain(rows, budget, cap):
    """The loop over each project's files in order."""
    used, batch, want = {}, {}, {}
    for g, k, s in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = cap if s is None else max(min(s, cap), 0)
        if used.get(g, 0) and used[g] + s > budget:
            batch[g], used[g] = batch.get(g, 0) + 1, 0
        used[g] = used.get(g, 0) + s
        want[g, k] = batch.get(g, 0)
    return want


@pytest.mark.parametrize(("budget", "cap", "most"), [(100, 30, 40), (10, 10, 12), (50, 7, 3)])
def test_greedy_batches_equal_the_loop(spark, budget, cap, most):
    rng = random.Random(budget)
    rows = [(rng.choice(["p", "p", "q", None]), f"f{i:04}", rng.choice([0, 0, None, -3, *range(1, most)])) for i in range(500)]
    rows += [("empty", f"f{i}", 0) for i in range(3)] + [("one", "f", 5)] + [("late", "a", 0), ("late", "b", cap), ("late", "c", 0)]
    df = spark.createDataFrame(rows, FILES).withColumn("batch", F.lit("x")).withColumn("at", F.lit(1)).repartition(5)
    got = {(r[0], r[1]): r[2] for r in batches.greedy_batches(df, budget=budget, cap=cap, spread=2).collect()}
    assert got == plain(rows, budget, cap)


def test_greedy_batches_edges(spark):
    assert batches.greedy_batches(spark.createDataFrame([], FILES)).count() == 0
    with pytest.raises(ValueError, match="cap"):
        batches.greedy_batches(spark.createDataFrame([], FILES), budget=5, cap=6)


def test_latent_cosines_equal_a_dense_decomposition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    weights = vectors.tf_idf(docs, features=300).cache()
    rows = weights.collect()
    terms, keys = sorted({r["term"] for r in rows}), sorted({r["doc_id"] for r in rows})
    dense = np.zeros((len(keys), len(terms)))
    for r in rows:
        dense[keys.index(r["doc_id"]), terms.index(r["term"])] = r["weight"]
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    want = u[:, :8] * s[:8]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    found = {r[0]: r[1] for r in latent.latent_vectors(weights.repartition(6), 8).collect()}
    got = np.array([found[k] for k in keys])
    assert got.shape == want.shape and np.abs(got @ got.T - want @ want.T).max() < 1e-3
    weights.unpersist()


def test_latent_edges(spark):
    rows = [("a", "x", 1.0), ("a", "x", 1.0), ("b", "y", 3.0), (None, "y", 1.0), ("c", None, 1.0), ("d", "x", None)]
    df = spark.createDataFrame(rows, "name string, term string, weight double").withColumn("key", F.lit(1)).withColumn("id", F.lit(2))
    got = {r[0]: np.array(r[1]) for r in latent.latent_vectors(df, 5, "name").collect()}
    assert set(got) == {"a", "b", None} and abs(got["b"] @ got[None] - 1) < 1e-6 and abs(got["a"] @ got["b"]) < 1e-6
    assert latent.latent_vectors(df.limit(0), 5, "name").count() == 0
    with pytest.raises(ValueError, match="terms"):
        latent.latent_vectors(df, 5, "name", most_terms=1)


def test_one_pass_over_the_rows_gives_all_products(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    rows, vocabulary = vectors.tf_idf_rows(docs, features=300)
    assert vocabulary.count() == 300
    table = rows.toArrow()
    dense = np.zeros((len(table), 300))
    for i, (ids, weights) in enumerate(zip(table.column("ids").to_pylist(), table.column("weights").to_pylist(), strict=True)):
        dense[i, ids] = weights
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    want = u[:, :8] * s[:8]
    want /= np.linalg.norm(want, axis=1, keepdims=True)

    def got():
        found = {r[0]: r[1] for r in latent.latent_rows(rows.repartition(3), 300, 8).collect()}
        return np.array([found[k] for k in table.column("doc_id").to_pylist()])

    plain = latent._product
    monkeypatch.setattr(latent, "_product", None)
    for head, cells in ((1024, 1 << 31), (20, 1000)):  # dense columns alone in one task; few of them in several
        monkeypatch.setattr(latent, "_HEAD", head)
        monkeypatch.setattr(latent, "_CELLS", cells)
        x = got()
        assert np.abs(x @ x.T - want @ want.T).max() < 1e-3
    monkeypatch.setattr(latent, "_product", plain)
    monkeypatch.setattr(latent, "GRAM_TERMS", 10)
    x = got()
    assert np.abs(x @ x.T - want @ want.T).max() < 1e-3


def test_tf_idf_counts_terms_without_shuffling_the_rare(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(80)]
    texts = {i: " ".join(rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.randint(0, 90))) + rng.choice([" x.", " Ünder_score, w0é W0É", ""]) for i in range(60)}
    texts |= {60: None, 61: "", 62: "a b c", 63: "only once here", 64: "same " * 50, 65: "same " * 50}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    own = {k: re.findall(r"\w{2,}", (t or "").lower()) for k, t in texts.items()}
    tf = {k: Counter(w) + Counter(map(" ".join, zip(w, w[1:], strict=False))) for k, w in own.items()}
    total, dfs = sum(tf.values(), Counter()), Counter(t for c in tf.values() for t in c)

    def plain(features):
        known = sorted(total, key=lambda t: (-total[t], t.encode()))[:features]
        raw = {k: {t: (1 + math.log(c[t])) * (math.log((1 + len(texts)) / (1 + dfs[t])) + 1) for t in known if c[t]} for k, c in tf.items()}
        return {(k, t, round(w / math.sqrt(sum(x * x for x in v.values())), 9)) for k, v in raw.items() for t, w in v.items()}

    calls, totals = [], vectors._totals
    monkeypatch.setattr(vectors, "_totals", lambda most: calls.append(most) or totals(most))
    for at_once, share in ((1 << 20, 1 << 17), (500, 200), (500, 60)):
        monkeypatch.setattr(vectors, "_WORDS", at_once)
        monkeypatch.setattr(vectors, "_SHARE", share)
        for features in (12, 40, 100_000):
            found = vectors.tf_idf(df, features=features).collect()
            assert {(r[0], r[1], round(r[2], 9)) for r in found} == plain(features) and len(found) == len(plain(features))
    assert calls.count(0) < calls.count(7) == 9 and calls.count(0) > 0
    again = vectors.tf_idf(df.union(df.where("doc_id = 63")), features=40)
    assert again.where("doc_id = 64").count() == len([1 for k, *_ in plain(40) if k == 64])
    assert vectors.tf_idf(df.limit(0), features=40).count() == 0
