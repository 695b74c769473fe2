import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from textquarry.llm import context_mixing as cm, lm_scoring, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unigrams(rows):
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}


def test_scores_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = unigrams([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = lm_scoring.score(docs).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_unseen_documents_score_above_unigrams(spark):
    got = lm_scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def model(bits=12, seed=1):
    counts = np.zeros((256, 256), np.int64)
    text = b"ab ba abba baab " * 30
    np.add.at(counts, (np.frombuffer(text[:-1], np.uint8), np.frombuffer(text[1:], np.uint8)), 1)
    rng = np.random.default_rng(seed)
    tables = [cm.odds_of(rng.integers(0, 9, (1 << cm.slot_bits(k, bits), 2))) for k in cm.ORDERS]
    return cm.tree_of(counts), tables, (cm.first_weights() + rng.normal(size=(cm.GATES, cm.INPUTS)) * 0.05).astype(np.float32), bits


def scores(texts, tree, tables, w, bits):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return cm.log10_probabilities(cm.evidence(cm.decisions(np.frombuffer(b"".join(texts), np.uint8), offsets, tree, bits), tables, w))[0]


def scalar_score(text, tree, tables, w, bits):
    """The model again, one decision after another."""
    whole, u = (1 << 64) - 1, np.uint64
    text = bytes([cm.END] * 8) + bytes(b + 32 if 65 <= b <= 90 else b for b in text) + bytes([cm.END])
    shift, pending, total, n = np.zeros((cm.GROUPS, cm.INPUTS)), [], 0.0, 0
    for at in range(8, len(text)):
        code = text[at - 1] * 256 + text[at]
        begin = at
        while text[begin - 1] not in b" \t\n\v\f\r" and text[begin - 1] != cm.END:
            begin -= 1
        word = sum((b + 1) * pow(words._BASE, j, 1 << 64) for j, b in enumerate(text[begin:at])) & whole
        for step in range(tree.first[code], tree.first[code] + tree.length[code]):
            node, turn = int(tree.node[step]), int(tree.turn[step])
            odds = []
            for k, table in zip(cm.ORDERS, tables, strict=True):
                if k == 1:
                    slot = text[at - 1] * 256 + node
                else:
                    h = int.from_bytes(text[at - k : at], "big") + k if k else 0
                    h = (h * 0x9E3779B97F4A7C15) & whole
                    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & whole
                    h = int(words.mixed(np.array([(word + 77) & whole], u))[0]) if k == 0 else h
                    slot = ((h >> (64 - bits)) + node) & ((1 << bits) - 1)
                odds.append(int(table[slot]))
            gate = (abs(odds[-2]) >> 4) * cm.SURENESS + (abs(odds[-1]) >> 4)
            group = (gate >> 1) & (cm.GROUPS - 1)
            x = np.array([*(v / cm.SCALE for v in odds), cm.CONSTANT])
            sign = 2 * turn - 1
            q = 1 / (1 + math.exp(-sign * float((w[gate] + shift[group]) @ x)))
            q = min(max(q, 1e-5), 1 - 1e-5)
            total += math.log10(q)
            pending.append((group, cm.STEP * (1 - q) * sign * x))
            n += 1
            if n % cm.REFINE == 0:
                for g, step_ in pending:
                    shift[g] += step_
                pending = []
    return total


def test_scores_equal_a_scalar_model():
    tree, tables, w, bits = model()
    texts = [b"", b"a", b"Abba ba\nabab", b"ab ba  zebra \xc3\xa9 " * 40, b"x" * 90]
    got = scores(texts, tree, tables, w, bits)
    assert got == pytest.approx([scalar_score(t, tree, tables, w, bits) for t in texts], rel=1e-4)


def test_scores_are_probabilities():
    """The model is a distribution over texts: texts of at most one symbol, and the empty text, take less than 1."""
    m = model()
    one = 10 ** scores([bytes([i]) for i in range(255) if not 65 <= i <= 90], *m)
    assert 0 < one.sum() + 10 ** scores([b""], *m)[0] < 1


def test_windows_of_a_long_text_give_its_score():
    m = model()
    text = b"ab ba abba zebra " * 300
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()])], ["text"])
    total, shift = 0.0, None
    for _, data, offsets, lead, last in cm.windows([batch], cm.REFINE * 5):
        value, shift = cm.log10_probabilities(cm.evidence(cm.decisions(data, offsets, m[0], m[3], lead, last), m[1], m[2]), shift)
        total += value[0]
    assert total == pytest.approx(scores([text], *m)[0], rel=2e-3)  # refined at other decisions


def test_learning_halves_large_counts():
    tree, _, _, bits = model()
    learner = cm.Learner(bits)
    text = np.frombuffer(b"aaaa " * 4000, np.uint8)
    for _ in range(8):
        learner.add(cm.decisions(text, np.array([0, len(text)]), tree, bits))
    seen = learner.counts[0].view(np.uint16)
    assert seen.max() < 40_000 and (learner.weights != cm.first_weights()).any()
    d = cm.decisions(text[:4000], np.array([0, 4000]), tree, bits)
    tables = [cm.odds_of(c.view(np.uint16).reshape(-1, 2).astype(np.int64)) for c in learner.counts]
    assert -cm.log10_probabilities(cm.evidence(d, tables, learner.weights))[0][0] * np.log2(10) / 4000 < 0.05


def test_scores_of_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "Word word WORD", "x"), (2, "Word word WORD", "x"), (3, "é" * 20_000, "x"), (4, "a b c " * 2000, "x")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    twice = [r for r in got if r["doc_id"] == 2]
    assert len({(r["base_score"], r["score"], r["n_known"]) for r in twice}) == 1 and twice[0]["n_tokens"] == 4
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline_stages_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
    assert docs.where("not round_trip").count() == 0
    assert docs.select(F.sum("n_tokens")).first()[0] == docs.select(F.sum(F.size("ids"))).first()[0]


def test_run_equals_its_stages_with_odd_rows(spark, sf, tmp_path):
    """Also with nulls, an empty text and repeated rows among the documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (990001, "", None, None, 0), (990002, None, "en", "s", None)], docs.schema)
    docs.union(odd).union(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = corpus_pipeline.stored(stage(spark, want, str(tmp_path)))
    rows = lambda df: sorted((r["doc_id"], r["n_tokens"], r["round_trip"], tuple(r["ids"])) for r in df.collect())
    assert got.columns == ["doc_id", "n_tokens", "round_trip", "ids"] and rows(got) == rows(want)
    assert not {None, 990001, 990002} & {r["doc_id"] for r in got.collect()}


def test_model_comes_from_all_training_documents(spark, monkeypatch):
    """Also a table without documents of any one residue learns its weights, and each training document is met once."""
    rows = [(i, f"text number {i} says hello to the world, " * 5) for i in range(200) if zlib.crc32(str(i).encode()) % 25 and zlib.crc32(str(i).encode()) % 5 != 1]
    seen, made = [], lm_scoring._model
    monkeypatch.setattr(lm_scoring, "_model", lambda train, *rest: seen.append((train.count(), made(train, *rest))) or seen[-1][1])
    assert lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)
    assert seen[0][0] == len(rows)
    tables, weights = seen[0][1]
    assert not np.array_equal(weights, cm.first_weights()) and all(t.any() for t in tables)


def test_a_slice_is_predicted_before_it_is_counted():
    """Nothing is known of the first slice, so only the constant's weight can move; the second is known from the first."""
    tree, _, _, bits = model()
    d = cm.decisions(np.frombuffer(b"abba ab " * 50, np.uint8), np.array([0, 400]), tree, bits)
    learner = cm.Learner(bits)
    learner.add(d)
    assert (learner.weights[:, :-1] == cm.first_weights()[:, :-1]).all()
    learner.add(d)
    assert (learner.weights[:, :-1] != cm.first_weights()[:, :-1]).any()
    assert all(int(c.view(np.uint16).sum()) == 2 * len(d.turn) for c in learner.counts)


def test_low_orders_predict_where_longer_contexts_are_new():
    learnt = b"x1ab y2ab z3ab w4ab " * 50
    tree, _, _, bits = model(bits=16)
    learner = cm.Learner(bits)
    learner.add(cm.decisions(np.frombuffer(learnt, np.uint8), np.array([0, len(learnt)]), tree, bits))
    new = cm.decisions(np.frombuffer(b"4w3zab", np.uint8), np.array([0, 6]), tree, bits)  # only "a", seen often, predicts "b"
    odds = [cm.odds_of(c.view(np.uint16).reshape(-1, 2).astype(np.int64)).take(slot) for c, slot in zip(learner.counts, new.slots, strict=True)]
    end = len(new.turn) - tree.length[ord("b") * 256 + cm.END]
    b = range(end - tree.length[ord("a") * 256 + ord("b")], end)
    assert set(cm.ORDERS) >= {1, 2, 3, 0}
    assert all(any(abs(int(v[i])) > 3 * cm.SCALE for v in odds) for i in b)


def test_short_texts_are_refined():
    """A text of some hundred bytes scores better than by its first weights, and alone the same as beside others."""
    tree, tables, w, bits = model()
    tables = [np.full_like(t, 9) for t in tables]
    text = b"qz" * 100
    e = cm.evidence(cm.decisions(np.frombuffer(text, np.uint8), np.array([0, len(text)]), tree, bits), tables, w)
    fixed = -np.log10(1 + np.exp(-e.z.astype(np.float64) * (2 * e.turn - 1))).sum()
    alone = cm.log10_probabilities(e)[0][0]
    assert alone > fixed + 1
    together = scores([b"", text, b"other words " * 40, text, b"a"], tree, tables, w, bits)
    assert together[1] == pytest.approx(together[3], rel=1e-9) and together[1] == pytest.approx(alone, rel=1e-6)
    parts = [cm.evidence(cm.decisions(np.frombuffer(t, np.uint8), np.array([0, len(t)]), tree, bits), tables, w) for t in (text, b"a b", text)]
    assert cm.log10_probabilities(cm.joined(parts))[0][[0, 2]] == pytest.approx([alone, alone], rel=1e-6)


def test_packed_counts_come_back():
    rng = np.random.default_rng(2)
    block = np.where(rng.random(2 * lm_scoring._BLOCK) < 0.1, rng.integers(0, 65536, 2 * lm_scoring._BLOCK), 0).astype(np.uint16)
    assert (lm_scoring._unpacked(lm_scoring._packed(block), np.uint16) == block).all()
    assert (lm_scoring._unpacked(lm_scoring._packed(block.astype(np.int64) << 30), np.int64) == block.astype(np.int64) << 30).all()
