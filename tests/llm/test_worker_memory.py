"""What a worker holds beside its batch: a few MB, however much text the batch has."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from evalloom.llm import language_id, packing, queries
from evalloom.llm import minhash_dedup as md


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij      ", k=2000)) for _ in range(2000)]
    return pa.record_batch([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def peak(rows) -> float:
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_language_features_in_small_pieces(batch):
    x = [language_id.features(b.column("text")) for b in language_id._bounded([batch])]
    assert np.array_equal(np.vstack(x), language_id.features(batch.column("text")))
    assert peak(language_id.features(b.column("text")) is None or b for b in language_id._bounded([batch])) < 24


def test_sketches_in_small_pieces(batch):
    list(md._sketch(4)([batch.slice(0, 10)]))
    assert peak(md._sketch(4)([batch])) < 32


def test_remembered_words_are_bounded():
    tokens = packing.Tokens(queries.tokenizer_file())
    most = 0
    for i in range(0, 250_000, 1000):
        tokens(" ".join(f"x{k}" for k in range(i, i + 1000)))
        most = max(most, len(tokens.seen))
    assert 50_000 < most <= 101_000
