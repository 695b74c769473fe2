import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textquarry.llm import mixing, sharding


def placed(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def test_shards_are_near_equal_whole_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    rows = placed(sharding.shards(docs, 8))
    assert sorted((i, s, c) for i, s, c, _, _ in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items())
    slots, total, groups = defaultdict(list), Counter(), defaultdict(set)
    for i, size, _, shard, slot in rows:
        slots[shard].append(slot)
        total[shard] += size
        groups[texts[i]].add(shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in groups.values())
    assert max(total.values()) - min(total.values()) <= max(s for _, s, *_ in rows) * 2


def test_a_huge_group_is_split_and_others_are_not(spark):
    rows = [(i, "hot text") for i in range(600)] + [(600 + i, f"text {i}") for i in range(1200)]
    got = placed(sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 10))
    total = Counter()
    for _, size, _, shard, _ in got:
        total[shard] += size
    assert max(total.values()) - min(total.values()) < 0.03 * sum(total.values())
    assert set(total) == set(range(10))


def test_shards_of_odd_rows(spark):
    rows = [(None, None, "x"), (None, "", "x"), (1, "é" * 50_000, "x"), (1, "é" * 50_000, "x"), (2, "b", "x")]
    got = placed(sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, shard string")))
    assert len(got) == 5 and sorted(s for _, s, *_ in got) == [16, 16, 17, 100_016, 100_016]
    assert placed(sharding.shards(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_written_shards_hold_every_row(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_shard_of_equals_bisection(spark):
    bounds = [3, 3, 8, 20]
    got = spark.range(25).select(F.col("id"), sharding.shard_of(F.col("id"), bounds).alias("s")).collect()
    assert all(r["s"] == sharding.shard_index(r["id"], bounds) for r in got)


def exponent_by_hand(totals, budget, limit):
    total = sum(totals)
    good = lambda e: max(budget / total * (t / total) ** (e - 1) for t in totals) / sum((t / total) ** e for t in totals) <= limit
    if good(0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        s = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 40))), s, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")


def test_exponent_is_the_bisected_one(spark, sources):
    totals = spark.createDataFrame([("a", 100), ("b", 900), ("c", 30)], "source string, t long")
    for limit in (1.2, 3.0, 100.0):
        assert mixing.exponent(totals, 1030.0, limit, None) == pytest.approx(exponent_by_hand([100, 900, 30], 1030, limit), abs=2**-39)
    import math

    e = mixing.exponent(totals, 1030.0, None, 1.0)
    w = [(t / 1030) ** e for t in (100, 900, 30)]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert h == pytest.approx(1.0, abs=1e-6)


def test_plan_keeps_budgets_and_epochs(sources):
    rows = mixing.plan(sources, repetition_limit=1.5).collect()
    tokens, docs = Counter(), defaultdict(Counter)
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
        docs[r["source"]][r["doc_id"]] += 1
    totals = {r["source"]: r["t"] for r in mixing.documents_by_source(sources).groupBy("source").agg(F.sum("n").alias("t")).collect()}
    budget = sum(totals.values())
    weights = {r["source"]: r["weight"] for r in rows}
    assert sum(weights.values()) == pytest.approx(1)
    for s, t in totals.items():
        assert weights[s] * budget - 41 <= tokens[s] <= weights[s] * budget
        assert tokens[s] <= 1.5 * t + 1e-6 and max(docs[s].values()) - min(docs[s].values()) <= 1
    assert len({(r["source"], r["epoch"], r["block_rank"], r["position"]) for r in rows}) == len(rows)


def test_plan_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, mixing.plan(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("weight", F.round("weight", 9)).collect()))
    assert got == sorted(con.execute(mixing.ORACLE).fetchall())


def test_mix_repeats_rows(sources):
    got = mixing.mix(sources)
    assert got.columns == sources.columns
    copies = {r["doc_id"]: r["count"] for r in mixing.plan(sources).groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == copies


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "a b", "b"), (2, "x " * 20_000, "c"), (2, "x " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs, repetition_limit=10.0).where("doc_id = 2").count() % 2 == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.plan(docs.where("doc_id is null")).count() == 0
