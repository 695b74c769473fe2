import hashlib
import random

import numpy as np
import pytest

from textquarry.llm import prefix_free, substring_dedup

LETTERS = "abcdefgh ij\nklm,é☃"


def plain(rows, length=100):
    """(id, n_bytes, n_removed, n_spans, sha256) by a set of all strings seen so far; rows are in order."""
    seen, out = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def corpus(rng, n, longest=900):
    """Prose with copies, near copies, passages, runs of one letter and short texts."""
    word = lambda k: "".join(rng.choice(LETTERS) for _ in range(k))
    passages = [word(rng.choice([40, 99, 100, 101, 130, 260])) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25 and texts:
            t = rng.choice(texts)
            if kind < 0.15 and t:
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(["", "X", "many more letters"]) + t[at + rng.randint(0, 3) :]
        elif kind < 0.6:
            t = "".join(rng.choice([word(rng.randint(0, 120)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30) :]]) for _ in range(rng.randint(1, 7)))
        elif kind < 0.7:
            t = rng.choice("az") * rng.randint(0, 400)
        else:
            t = word(rng.randint(0, longest))
        texts.append(t)
    return texts


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def docs(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "clash", 1, b"x") for i, t in rows], "doc_id long, text string, kind string, slice int, kept binary").repartition(parts)


@pytest.mark.parametrize(("seed", "length", "size", "bucket"), [(1, 100, 1500, 700), (2, 100, 1 << 21, 1 << 24), (3, 16, 3000, 2000), (4, 37, 500, 300), (5, 100, 300, 5000)])
def test_equals_a_set_of_strings(spark, seed, length, size, bucket):
    rng = random.Random(seed)
    rows = list(enumerate(corpus(rng, 160)))
    got = found(substring_dedup.remove_repeats(docs(spark, rows), length, slice_bytes=size, bucket_bytes=bucket))
    assert got == plain(rows, length)
    assert sum(r[2] for r in got) > 1000


def test_nulls_empties_ties_and_other_columns(spark):
    rng = random.Random(8)
    same = "".join(rng.choice(LETTERS) for _ in range(300))
    rows = [(None, same), (-5, same), (3, None), (4, ""), (5, "short"), (6, same), (6, same), (7, same[:120] + "!" + same[120:])]
    got = substring_dedup.remove_repeats(docs(spark, rows))
    assert [(r[0], r[2]) for r in found(got)] == [(i, n) for i, _, n, *_ in plain(rows)]
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert substring_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0
    twice = found(substring_dedup.remove_repeats(docs(spark, [(1, same), (1, same), (1, same)])))
    assert sorted(r[2] for r in twice) == [0, 300 + same.count("é") + 2 * same.count("☃"), 300 + same.count("é") + 2 * same.count("☃")]


def test_long_texts_go_in_pieces(spark):
    rng = random.Random(9)
    part = "".join(rng.choice(LETTERS) for _ in range(3000))
    long = part + "".join(rng.choice(LETTERS) for _ in range(2000)) + part[500:2500] + "z" * 2500
    rows = [(1, part[1000:1400]), (2, long), (3, long[4000:] + part), (4, "z" * 150)]
    assert found(substring_dedup.remove_repeats(docs(spark, rows), slice_bytes=1000, bucket_bytes=2000)) == plain(rows)
    assert {r["kept"] for r in substring_dedup.remove_repeats(docs(spark, rows), with_text=False, slice_bytes=1000).collect()} == {None}


def test_text_of_megabytes(spark):
    rng = np.random.default_rng(2)
    block = rng.integers(97, 123, 2_500_000).astype(np.uint8).tobytes().decode()
    rows = [(1, block + block[1_000_000:1_500_000]), (2, "a" * 3_000_000), (3, block[:200])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.remove_repeats(docs(spark, rows, 3), with_text=False).collect()}
    assert got == {1: (500_000, 1), 2: (2_999_999, 1), 3: (200, 1)}


def test_order_of_windows_is_that_of_their_bytes():
    rng = np.random.default_rng(4)
    for length, letters in ((16, 1), (16, 2), (100, 3), (50, 40)):
        base = rng.integers(0, letters, 2000).astype(np.uint8)
        texts = [base[a : a + n] for a, n in zip(rng.integers(0, 1500, 9), rng.integers(length, length + 400, 9), strict=True)]
        ends = np.cumsum([len(t) for t in texts])
        data, begins = np.concatenate(texts), np.append(0, ends[:-1])
        at, same = prefix_free.window_order(data, begins, ends, length)
        windows = [data[i : i + length].tobytes() for i in at]
        assert sorted(at.tolist()) == [i for b, e in zip(begins, ends, strict=True) for i in range(b, e - length + 1)]
        assert windows == sorted(windows) and same.tolist() == [False] + [x == y for x, y in zip(windows[1:], windows, strict=False)]


def test_phrases_are_prefix_free():
    data = np.random.default_rng(6).integers(97, 101, 20_000).astype(np.uint8)
    at = prefix_free.triggers(data, np.array([len(data)]))
    suffixes = {data[i:e].tobytes() for b, e in zip(at[:-1], at[1:] + 8, strict=True) for i in range(b, e - 8)}
    ordered = sorted(suffixes)
    assert len(at) > 500 and not any(y.startswith(x) for x, y in zip(ordered, ordered[1:], strict=False))
