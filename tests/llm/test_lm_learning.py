"""What the language model learns, against a plain loop over decisions, and how tasks' counts are added up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import context_mixing as cm, lm_scoring


def tree():
    counts = np.zeros((256, 256), np.int64)
    text = np.frombuffer(b"ab ba abba baab the cat " * 30, np.uint8)
    np.add.at(counts, (text[:-1], text[1:]), 1)
    return cm.tree_of(counts)


def plain(started, slices):
    """Counts and weights again, each decision on its own."""
    counts = [c.view(np.uint16).reshape(-1, 2).astype(np.int64) for c in started]
    w, squares = cm.first_weights().astype(np.float64), np.full((cm.GATES, cm.INPUTS), 1e-10)
    for d in slices:
        for c, slot in zip(counts, d.slots, strict=True):
            for _ in range(2):
                for s in np.unique(slot[(c[slot] >= 1 << 14).any(axis=1)]):
                    c[s] = (c[s] + 1) // 2
        odds = np.array([cm.odds_of(c[slot]) for c, slot in zip(counts, d.slots, strict=True)], np.int64)
        for at in range(0, len(d.turn), cm.BLOCK):
            step = np.zeros_like(w)
            for i in range(at, min(at + cm.BLOCK, len(d.turn))):
                x = np.append(odds[:, i] / cm.SCALE, cm.CONSTANT)
                gate = (abs(odds[-2, i]) >> 4) * cm.SURENESS + (abs(odds[-1, i]) >> 4)
                step[gate] += (d.turn[i] - 1 / (1 + np.exp(-np.clip(w[gate] @ x, -20, 20)))) * x / cm.BLOCK
            squares += step * step
            w += 0.05 * step / np.sqrt(squares)
        for c, slot in zip(counts, d.slots, strict=True):
            np.add.at(c, (slot, d.turn.astype(np.int64)), 1)
    return counts, w


def test_learning_equals_a_plain_loop():
    bits, t, rng = 14, tree(), np.random.default_rng(3)
    words = [b"the ", b"cat ", b"abba ", b"zebra ", b"a", b"\xc3\xa9 "]
    slices = []
    for n in (500, 900, 7, 4000):
        text = np.frombuffer(b"".join(words[i] for i in rng.integers(0, len(words), n)), np.uint8)
        slices.append(cm.decisions(text, np.array([0, len(text) // 3, len(text) // 3, len(text)]), t, bits))
    slices += [slices[-1]] * 3
    learner = cm.Learner(bits)
    for c in learner.counts:  # so that some are halved
        c[: len(c) // 2] = 16_300 | 200 << 16
    started = [c.copy() for c in learner.counts]
    for d in slices:
        learner.add(d)
    want, w = plain(started, slices)
    for got, c in zip(learner.counts, want, strict=True):
        assert (got.view(np.uint16).reshape(-1, 2) == c).all()
    assert learner.weights == pytest.approx(w, rel=2e-3, abs=2e-4)
    assert learner.n == sum(len(d.turn) for d in slices)


def test_equal_texts_score_equally_beside_any_others():
    bits, t = 14, tree()
    rng = np.random.default_rng(4)
    tables = [cm.odds_of(rng.integers(0, 40, (1 << cm.slot_bits(k, bits), 2))) for k in cm.ORDERS]
    w = (cm.first_weights() + rng.normal(size=(cm.GATES, cm.INPUTS)) * 0.05).astype(np.float32)
    text = b"the cat and a zebra " * 17
    texts = [x for i in range(300) for x in (text, b"abba " * int(rng.integers(0, 60)) + b"x" * (i % 7))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    e = cm.evidence(cm.decisions(np.frombuffer(b"".join(texts), np.uint8), offsets, t, bits), tables, w)
    got = cm.log10_probabilities(e)[0]
    assert len(set(got[::2])) == 1 and np.isfinite(got).all()


def test_tasks_add_up_alike_in_one_and_two_steps(spark, monkeypatch):
    rows = [(i, f"text number {i} says hello to the world, " * 5) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id").sortWithinPartitions("doc_id").persist()
    t = spark.sparkContext.broadcast(tree())
    made = []
    for at_once in (64, 2):
        monkeypatch.setattr(lm_scoring, "AT_ONCE", at_once)
        made.append(lm_scoring._model(train, t, 16))
    (one, w1), (two, w2) = made
    assert all((a == b).all() and a.any() for a, b in zip(one, two, strict=True)) and w1 == pytest.approx(w2, rel=1e-6)
    learner = [cm.Learner(16) for _ in range(9)]
    parts = train.select(F.spark_partition_id().alias("p"), "text").toArrow()
    for p, who in enumerate(learner):
        part = parts.filter(np.asarray(parts.column("p")) == p).select(["text"]).combine_chunks()
        for _, data, offsets, lead, last in cm.windows(part.to_batches(), cm.LEARN_BYTES):
            who.add(cm.decisions(data, offsets, t.value, 16, lead, last))
    for k, table in enumerate(one):
        total = sum(who.counts[k].view(np.uint16).reshape(-1, 2).astype(np.int64) for who in learner)
        assert (table == cm.odds_of(total)).all()
    train.unpersist()
