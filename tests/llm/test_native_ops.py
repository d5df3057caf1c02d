"""Operators 3, 5, 6 and 7 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, embedding_dedup, line_dedup, lm_score, mixing

from .test_python_ops import ODD, frame, words


def removed_lines(rows, share):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [(i, k, frozenset(words(x))) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    gone = set()
    for p, (i, k, s) in enumerate(lines):
        if s and any(100 * len(s & z) >= share * len(s | z) for j, m, z in lines[:p] if z and (j, m) < (i, k) or j is None):
            gone.add((i, k))
    return gone


def test_line_dedup(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))] for _ in range(30)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            w = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            lines.append("  ".join(w).title() if rng.random() < 0.2 else " ".join(w))
        rows.append((i + 10, "\n".join(lines)))
    rows += [(200, rows[5][1]), (201, "a b c d e\n\nb a c e d\nx"), (1, None), (2, ""), (3, " \n\t"), (6, "x " * 3000), (6, "x " * 3000)]
    gone = removed_lines(rows, 80)
    got = line_dedup.remove_repeats(frame(spark, rows).withColumn("n_lines", F.lit("?"))).collect()
    assert len(got) == len(rows)
    want = {(i, t): None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, want[i, t]) for i, t in rows)
    assert sum(r.n_removed for r in got) == sum(1 for i, t in rows for k in range(len((t or "").split("\n"))) if (i, k) in gone)
    assert len(gone) > 50
    assert not line_dedup.remove_repeats(frame(spark, [])).collect()


def shares(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    at_top, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in at_top)
        level = rest / sum(w[s] for s in sizes if s not in at_top) if len(at_top) < len(sizes) else 0
        over = {s for s in sizes if s not in at_top and level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in at_top else level * w[s] for s in sizes}
        at_top |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["b", "a", "a", "a", None, "é", "z"])) for i in range(600)] + [(None, "x y", "a"), (None, None, None), (7, "", "only empty"), (7, "", "only empty"), (3, "a\x0bb\x0cc\rd\te\nf  g", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("size"), F.lit(2).alias("mix"), F.lit(3).alias("part"))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = shares(sizes, (5, 2, 1), 3)
    got = mixing.planned(df).select("doc_id", "source", "mix.*").collect()
    again = mixing.planned(df.repartition(7)).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert r.taken == r.size * r.copies <= 3 * r.size
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    out = mixing.mixed(df).drop("mix", "part", "size")
    assert Counter(map(tuple, out.select("doc_id", "source").collect())) == Counter({k: n for k, n in Counter((r.doc_id, r.source) for r in got for _ in range(r.copies)).items()})
    assert not mixing.planned(df.limit(0)).collect() and not mixing.mixed(df.limit(0)).collect()


def test_curriculum_leans(spark):
    """Of a source whose schedule falls, more than half comes in the first half of training."""
    n = spark.range(1, 1000).select((F.col("id") / 1000).alias("share"))
    for lean, low, high in ((-0.5, 0.6, 0.65), (0.0, 0.49, 0.51), (0.5, 0.35, 0.4)):
        early = n.where(mixing.time_of(F.col("share"), F.lit(lean)) < 0.5).count() / 999
        assert low <= early <= high


def test_lm_scores(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    rows = [(i + 20, " ".join(vocabulary[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += [(900, "neverseen Word\nneverseen"), *ODD]
    df = frame(spark, rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    small = lm_score.HELD
    for most in (small, 40):  # with most words' counts held, and joined
        lm_score.HELD = most
        try:
            got = lm_score.score(df.where(common.remainder(F.col("doc_id")) != 1), df).collect()
        finally:
            lm_score.HELD = small
        want = Counter()
        for i, t in rows:
            tokens = [*words(t), None]
            want[i, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens), 5)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
    none = lm_score.score(df.limit(0), frame(spark, ODD)).collect()
    assert len(none) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert not lm_score.score(df, frame(spark, [])).collect()


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    triples = np.unique(rng.integers(0, lm_score.CLASSES**3, 5000))
    table = lm_score.train(triples, rng.integers(1, 50, len(triples)))
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-3)


def test_lm_learns(spark):
    """On held-out texts the model gives more than the unigram that it is held against."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.score(docs.where(common.remainder(F.col("doc_id")) != 1), docs).where(common.remainder(F.col("doc_id")) == 1)
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16)).astype(np.float32)
    rows = []
    for i in range(300):
        v = x[rng.integers(60)] + rng.standard_normal(16).astype(np.float32) * rng.choice([0, 0.02, 0.1, 0.2])
        rows.append((i + 10, v.tolist(), int(rng.integers(2))))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [float("inf")] * 16, 0), (906, [1.0], 0), (907, [2.0], 0), (908, [], 0), (909, (np.array(rows[1][1]) * 3).tolist(), rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", F.lit(1).alias("node"), F.lit(1).alias("n"))
    good = [(i, np.array(v, dtype=float), z) for i, v, z in rows if z is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for k, (i, v, z) in enumerate(good):
        for j, w, y in good[:k]:
            if z == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, block
    try:
        got = embedding_dedup.near_duplicates(df).collect()
    finally:
        embedding_dedup.BLOCK = old
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((r[0], links[r[0]], root(r[0]), root(r[0]) == r[0]) for r in rows)
    assert sum(links.values()) > 300
    assert not embedding_dedup.near_duplicates(df.limit(0)).collect()
