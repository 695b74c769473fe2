import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textquarry.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


ODD = [
    None, "", " \n\t", "a", "é ü 中文  x", "same line\nsame line\n same line\n\n\nsame line", "a b c d e f g h " * 6, "x " * 40, "one\rtwo\vthree\ffour", "#*$%&|<> |", "\n" * 5,
    " ".join(f"w{i}" for i in range(300)) + " w0 w1 w2 w3 w4 w5 w6 w7 tail", "z" * 5000,
]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_base_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a b", "x"), (0, None, "x")], "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(map(tuple, quality_rules.judge(docs, none).drop("kept", "probability").collect()), key=repr)
    assert got == sorted([(i, *base(t)) for i, t in enumerate(ODD)] + [(None, *base("a b")), (0, *base(None))], key=repr)


def test_base_counts_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r[0]: tuple(r)[1:7] for r in quality_rules.judge(docs, labels).collect()}
    assert got == {r[0]: base(r[1]) for r in docs.select("doc_id", "text").collect()}


def test_rules_tell_labels_apart(spark, labelled):
    docs, labels = labelled
    got = quality_rules.judge(docs, labels).join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert got > 0.97
    assert quality_rules.keep(docs.withColumn("kept", F.lit("clash")), labels).columns == ["doc_id", "text", "kept"]


def test_rules_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert quality_rules.judge(empty, none).count() == 0
    assert quality_rules.keep(empty, none).count() == 0


def test_classifier_held_out(spark, labelled):
    docs, labels = labelled
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_classifier_never_learns_held_out_labels(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a b", "x"), (0, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(ODD) + 2 and {r["score"] for r in got} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert quality_classifier.keep(docs, labels).count() == len(ODD) + 2
