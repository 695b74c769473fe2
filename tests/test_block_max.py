import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textquarry.functions.texts import tokens
from textquarry.operators import block_max, passage_scan, retrieval, vectors
from textquarry.sources.shared import new_path


def made(spark, n=400, seed=5):
    rng = random.Random(seed)
    rare = [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1]), (n + 3, rows[0][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, term string").repartition(3)
    asked = [(j, " ".join(rng.choices(rare, k=4) + ["the", "of", "the"])) for j in range(12)] + [(50, "nothing known"), (51, "the"), (52, None), (53, "r1 of r1")]
    return docs, spark.createDataFrame([(*r, "clash") for r in asked], "item_id long, text string, q string")


def ranks(df, by, k=5):
    top = retrieval.top_k(df, k, by, "item_id", "doc_id")
    return {(r["item_id"], r["doc_id"], r["rank"], round(r[by], 7)) for r in top.collect()}


@pytest.mark.parametrize("block", [4, 128])
def test_top_k_equals_full_scores(spark, monkeypatch, block):
    monkeypatch.setattr(block_max, "BLOCK", block)
    docs, asked = made(spark)
    full = retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n")))
    index = block_max.build(docs, new_path(spark, "passages"))
    assert ranks(block_max.normed_top(index, asked, 5), "norm") == ranks(full, "norm")
    only = block_max.build(docs, new_path(spark, "passages"), asked=spark.createDataFrame([("the",), ("r1",), ("of",)], "term string"))
    assert ranks(block_max.normed_top(only, asked.where("item_id = 53"), 5), "norm") == ranks(full.where("item_id = 53"), "norm")


def test_few_postings_are_joined(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    index = block_max.build(docs, new_path(spark, "passages"))
    weights = block_max.weighed(index, asked)
    n = block_max.joined_rows(index, weights, block_max.floors(index, weights, 10)).first()
    assert n["read"] < n["all"] / 5


def test_every_passage_meets_a_query(spark):
    docs = spark.createDataFrame([(i, "all " + "x" * (i % 3 + 1) + " y" * (i % 4)) for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "all y"), (2, "xx")], "item_id long, text string")
    full = retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n")))
    index = block_max.build(docs, new_path(spark, "passages"))
    assert ranks(block_max.normed_top(index, asked, 4), "norm", 4) == ranks(full, "norm", 4)


@pytest.mark.parametrize("deep", [6, 200])
def test_hybrid_equals_fusing_all(spark, deep):
    docs, asked = made(spark)
    rng = random.Random(9)
    rows = [(j, i, rng.random() ** 3 * 2 - 1) for j in range(12) for i in range(0, 404, 2)]
    cosines = spark.createDataFrame(rows, "item_id long, doc_id long, cosine double").cache()
    full = retrieval.fused(cosines, retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n"))))
    index = block_max.build(docs, new_path(spark, "passages"))
    near = retrieval.top_k(cosines, deep, "cosine", "item_id", "doc_id").select(F.col("item_id").alias("q"), F.col("doc_id").alias("k"), "cosine")
    of = lambda pairs: pairs.join(cosines.select(F.col("item_id").alias("q"), F.col("doc_id").alias("k"), "cosine"), ["q", "k"])
    assert ranks(block_max.hybrid_top(index, asked, near, of, 5), "final") == ranks(full, "final")


def test_empty_tables(spark):
    docs, asked = made(spark, 20)
    index = block_max.build(docs.limit(0), new_path(spark, "passages"))
    assert block_max.normed_top(index, asked, 3).count() == 0
    assert block_max.normed_top(block_max.build(docs, new_path(spark, "passages")), asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("block", [4, 128])
def test_known_queries_are_scored_without_shuffling_postings(spark, monkeypatch, block):
    monkeypatch.setattr(block_max, "BLOCK", block)
    docs, asked = made(spark)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(0, 404, 2)] + [(405, [1.0] * 8), (1, None), (900, [2.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    # queries 0 to 10 by two and 52, whose text is null, have vectors
    docs_v, queries_v = v.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), v.where("vec_id < 12 or vec_id = 52").withColumnRenamed("vec_id", "item_id")
    cosines = vectors.cosine_scores(docs_v, queries_v.where("embedding is not null"), query_key="item_id").withColumnRenamed("vec_id", "doc_id")
    bm25 = retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n")))
    index = block_max.build(docs, new_path(spark, "passages"), asked=asked.select(F.explode(tokens(F.col("text"))).alias("term")).distinct())
    assert not Path(index.folder.removeprefix("file://"), "blocks").exists()
    assert ranks(block_max.normed_top(index, asked, 5), "norm") == ranks(bm25, "norm")
    own = [df.select(F.col(c).alias(n), F.col("embedding").alias("v")) for df, c, n in ((v, "vec_id", "k"), (queries_v, "item_id", "q"))]
    got = block_max.fused_top(index, asked, *own, 5)
    assert ranks(got, "final") == ranks(retrieval.fused(cosines, bm25), "final")
    assert got.count() < 16 * 10


def test_known_terms_in_every_passage(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "all " + "x" * (i % 3 + 1) + " y" * (i % 4)) for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "all y"), (2, "xx")], "item_id long, text string")
    terms = asked.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    want = ranks(retrieval.min_max(retrieval.bm25(docs, asked), docs.agg(F.count("*").alias("n"))), "norm", 4)
    assert ranks(block_max.normed_top(block_max.build(docs, new_path(spark, "passages"), asked=terms), asked, 4), "norm", 4) == want
    monkeypatch.setattr(passage_scan, "_QUERIES", 1)
    monkeypatch.setattr(passage_scan, "_TOKENS", 3)
    monkeypatch.setattr(passage_scan, "_HELD", 2)
    assert ranks(block_max.normed_top(block_max.build(docs, new_path(spark, "passages"), asked=terms), asked, 4), "norm", 4) == want
    monkeypatch.setattr(block_max, "FEW_TERMS", 1)
    blocks = block_max.build(docs, new_path(spark, "passages"), asked=terms)
    assert blocks.rows is None and ranks(block_max.normed_top(blocks, asked, 4), "norm", 4) == want
    monkeypatch.setattr(block_max, "FEW_TERMS", 9)
    empty = block_max.build(docs.limit(0), new_path(spark, "passages"), asked=terms)
    assert block_max.normed_top(empty, asked, 3).count() == 0
