"""The language model's words: their own vectors, and sums over them, against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from evalloom.llm import lm_score


def test_words_of_a_class_follow_their_contexts(spark):
    """Two equally frequent words of one ending, each after another word."""
    rng = random.Random(5)
    common_words = [f"w{i}x{i}" for i in range(70)]
    rows = []
    for i in range(1500):
        w = [rng.choice(common_words) for _ in range(6)]
        rows.append((i, " ".join([*w[:3], *((("left", "zoing") if i % 20 else ("right", "zuing")) if i % 10 == 0 else ()), *w[3:]])))
    rows += [(5000 + i, f"{a} {b}") for i, (a, b) in enumerate([("left", "left"), ("right", "right")] * 1500)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    ask = spark.createDataFrame([(1, "left zoing"), (2, "left zuing"), (3, "right zuing"), (4, "right zoing")], "doc_id long, text string")
    small = lm_score.HELD
    for most in (small, 30):  # with the words' vectors held, and joined
        lm_score.HELD = most
        try:
            got = {r.doc_id: r.score for r in lm_score.score(training, ask).collect()}
        finally:
            lm_score.HELD = small
        assert got[1] > got[2] + 0.3 and got[3] > got[4] + 0.3


def test_sums_over_words():
    rng = np.random.default_rng(4)
    places = rng.normal(0, 1, (2, lm_score.CLASSES, lm_score.WIDTH + 1)).astype(np.float32)
    v = rng.integers(-20, 21, (50, lm_score.WIDTH + 1)).astype(np.int8)
    kind, n = rng.integers(100, 103, 50), rng.integers(1, 9, 50)
    batch = pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(n), pa.array([z.tobytes() for z in v], pa.binary())], names=["class", "n", "vector"])
    got = list(lm_score._added(lm_score._sums(SimpleNamespace(value={"places": places}))([batch, batch.slice(0, 0)])))[0]
    x = (places[0][:, None] + places[1][None]).reshape(-1, lm_score.WIDTH + 1).astype(float)
    for k, z in zip(got.column("class").to_pylist(), got.column("sums").to_pylist(), strict=True):
        want = (np.exp(x @ (v[kind == k].astype(float) / lm_score.STEP).T) * (n[kind == k] + 0.5)).sum(1)
        assert np.allclose(np.frombuffer(z), want, rtol=1e-4)
