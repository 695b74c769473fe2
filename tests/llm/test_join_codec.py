import random
import re
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor

from textquarry.llm import jaccard_join, sentencepiece_codec as codec
from textquarry.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(rows):
    """(set sizes, smallest reachable id) by counting shared shingles of all pairs."""
    sets, inverse = sets_of(rows), {}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = Counter(k for s in sets[i] for k in inverse.get(s, ()))
        for k, o in shared.items():
            if 100 * o >= 75 * (len(sets[i]) + len(sets[k]) - o):
                a, b = sorted((find(i), find(k)))
                root[b] = a
        for s in sets[i]:
            inverse.setdefault(s, []).append(i)
    return {(i, len(sets[i]), find(i)) for i in sets}


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        own = [word() for _ in range(rng.choice([3, 8, 25, 60]))]
        texts.append(own + (passage if rng.random() < 0.5 else []))
        for _ in range(rng.randint(0, 4)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    base = [word() for _ in range(80)]
    for _ in range(60):  # a chain of copies, each an edit of the one before
        base = list(base)
        base[rng.randrange(80)] = word()
        texts.append(base)
    rng.shuffle(texts)
    return [(i, " ".join(t).title() if i % 3 else " \n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "bits"), [(1, 16), (2, 17)])
def test_components_equal_brute_force(spark, seed, bits):
    rows = planted(seed) + [(9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "ONE two"), (9005, "one two three four five"), (9006, "five " * 3000), (9007, "five " * 4000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token string")
    assert {tuple(r) for r in jaccard_join.link(docs, sketch_bits=bits).collect()} == brute(rows)


def test_pairs_that_no_leader_has_are_joined_in_the_end(spark):
    """Without leaders' candidates, as when documents that quote a pair lead all its shingles, the last step still joins it."""
    rows = planted(3, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.link(docs, sketch_bits=16, leaders=()).collect()} == brute(rows)


def test_join_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in jaccard_join.link(docs, sketch_bits=18).collect()} == brute([tuple(r) for r in docs.collect()])


def test_join_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.link(docs, sketch_bits=16).collect()), key=repr)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (None, 2, None), (2, 2, 2)], key=repr)
    assert sorted((r[0] or -1) for r in jaccard_join.keep_one(docs, sketch_bits=16).collect()) == [-1, 2]
    assert jaccard_join.link(docs.limit(0), sketch_bits=16).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 199), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)} | {(200, 199)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [
    None, "", " ", "  a  b ", "Hello world\n\n  x\t", "ünïcode 中文字 🙂 🙂🙂", "a" * 700, "ab " * 3000, "x" + " " * 300 + "y", "\x00\x01 null", "▁mark ▁ ▁▁", "<s> </s> <unk> <0x0A>", "The the of, ing. 12345 #$%&",
    "".join(chr(i) for i in range(32, 700)),
]


def test_encoding_equals_the_library(spark, sf):
    library = SentencePieceProcessor(model_file=codec.MODEL_PATH)
    rng = random.Random(11)
    rows = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows += ODD + ["".join(rng.choice("abc  ▁ é\n中the") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = codec.encode(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text), text[:80]
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"] == ("▁" not in text)
    back = {r["doc_id"]: r["text"] for r in codec.decode(codec.encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(rows))


def test_encoding_of_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = codec.encode(docs).collect()
    assert len(got) == 3 and len({tuple(r["ids"]) for r in got}) == 1
    assert codec.encode(docs.limit(0)).count() == 0
