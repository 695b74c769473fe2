"""Texts far longer than a slice: memory follows the window, results are those of one piece."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from sentencepiece import SentencePieceProcessor

from textquarry.llm import jaccard_join, sentencepiece_codec as codec, words


def long_text(n):
    rng = random.Random(8)
    some = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    return " ".join(rng.choice(some) for _ in range(n)) + " " + "z" * 300_000 + " end"


def test_hashes_do_not_depend_on_windows(monkeypatch):
    data = np.frombuffer(long_text(60_000).encode(), np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]))
    monkeypatch.setattr(words, "WINDOW", 1 << 30)
    whole = words.span_hashes(data, starts, ends)
    monkeypatch.setattr(words, "WINDOW", 100_000)
    assert (words.span_hashes(data, starts, ends) == whole).all()


def test_ids_of_a_long_text_equal_the_library():
    text = long_text(150_000).replace("z" * 300_000, "z" * 3000)
    data, offsets = codec.prefixed(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    ids, begins, same = codec.long_text(data, codec.load(), 100_000)
    assert ids.tolist() == SentencePieceProcessor(model_file=codec.MODEL_PATH).encode(text) and same.all() and begins.tolist() == [0, len(ids)]


def test_shingles_of_a_text_of_50_mb_stay_near_its_words():
    text = ("lorem ipsum dolor " * 2_800_000).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.binary()).cast(pa.string())], ["text"])
    tracemalloc.start()
    for _, data, offsets in words.slices([batch], "text"):
        row, h = jaccard_join.shingles(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 3 * 2_800_000 - 4 and len(np.unique(h)) == 3 and peak < 20 * len(text)
