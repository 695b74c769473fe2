import random

import pytest
from pyspark.sql import functions as F

from textquarry.streaming import index_stats


def words(rng):
    return None if rng.random() < 0.15 else " ".join(rng.choices(["the", "The", "of", "a", "b", "c", "d.", "é"], k=rng.randint(0, 9)))


def made(seed=3, batches=5):
    """Batches of (seq, key, text), and the passages that are there in the end."""
    rng, state, out, seq = random.Random(seed), {}, [], 0
    for _ in range(batches):
        rows = []
        for _ in range(30):
            seq += 1
            k, text = rng.randint(0, 25), words(rng)
            rows.append((seq, k, text))
            state[k] = text
        rows.append((seq, None, "no key"))
        out.append(rows)
    return out, {k: t for k, t in state.items() if t is not None}


def rebuilt(state):
    df, total = {}, 0
    for t in state.values():
        ts = t.lower().split()
        total += len(ts)
        for w in set(ts):
            df[w] = df.get(w, 0) + 1
    return len(state), total, df


def now(spark, folder):
    n = index_stats.totals(spark, folder).first()
    return n["n"], n["total_len"], {r["term"]: r["df"] for r in index_stats.document_frequencies(spark, folder).collect()}


SCHEMA = "seq long, doc_id long, text string"


def test_stream_ends_with_the_statistics_of_a_rebuild(spark, tmp_path, monkeypatch):
    batches, state = made()
    feed, store = tmp_path / "feed", str(tmp_path / "store")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))
    real, killed = index_stats.counted, []

    def dying(*a):
        if len(killed) == 0 and len(index_stats.commits(spark, store).collect()) == 2:
            killed.append(1)
            # what a batch leaves that was cut off between its tables
            spark.createDataFrame([(1, 1, 5, [("junk", 1)])], "k long, sign int, len long, terms array<struct<term: string, tf: int>>").write.parquet(f"{store}/ledger/batch=2")
            spark.createDataFrame([("junk", 1)], "term string, df long").write.parquet(f"{store}/deltas/batch=2")
            raise RuntimeError("killed")
        return real(*a)

    monkeypatch.setattr(index_stats, "counted", dying)
    q = index_stats.maintained(stream(), store, str(tmp_path / "check"), seq="seq")
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(300)
    assert killed and "junk" not in now(spark, store)[2]
    q = index_stats.maintained(stream(), store, str(tmp_path / "check"), seq="seq")
    assert q.awaitTermination(300)
    assert now(spark, store) == rebuilt(state)
    there = {r["k"]: r["len"] for r in index_stats.passages(spark, store).collect()}
    assert there == {k: len(t.split()) for k, t in state.items()}


def test_a_repeated_batch_changes_nothing_and_compaction_goes_on(spark, tmp_path):
    batches, state = made(4, 3)
    store, small = str(tmp_path / "a"), str(tmp_path / "b")
    frame = lambda i: spark.createDataFrame(batches[i], SCHEMA)
    index_stats.apply(frame(0), 0, store, seq="seq")
    index_stats.apply(frame(1), 1, store, seq="seq")
    before = now(spark, store)
    index_stats.apply(frame(1), 1, store, seq="seq")
    assert now(spark, store) == before
    index_stats.compact(spark, store, small)
    assert now(spark, small) == before
    for folder in (store, small):
        index_stats.apply(frame(2), 2, folder, seq="seq")
        assert now(spark, folder) == rebuilt(state)


def test_empty_store_and_batch(spark, tmp_path):
    store = str(tmp_path / "none")
    assert now(spark, store) == (0, 0, {})
    index_stats.apply(spark.createDataFrame([], SCHEMA), 0, store)
    assert now(spark, store) == (0, 0, {}) and index_stats.commits(spark, store).count() == 1
    assert index_stats.passages(spark, store).where(F.col("len") > 0).count() == 0
