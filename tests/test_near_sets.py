"""Near-duplicates by bitmaps and blocks, against all pairs of sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import nearsets, overlap


def pieces(t, k=5):
    return {t[i : i + k] for i in range(len(t) - k + 1)} or {t}


def test_all_pairs_of_sets(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg𠀀", k=rng.randint(1, 7)))
    texts = []
    for n in (1, 3, 20, 60, 200, 700):
        base = [word() for _ in range(n)]
        for changes in (0, 0, 1, n // 30, n // 12, n // 5):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(n)] = word()
            texts.append(" ".join(w))
    texts += ["same text"] * 40 + ["", None, " ! "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sets = [(r.id, pieces(r.n)) for r in df.select("id", text.normalize(F.col("t")).alias("n")).collect() if r.n]
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets for b, y in sets if a < b and len(x & y) * 100 >= len(x | y) * 80}
    got = {(r.a, r.b): r.similarity for r in overlap.near_duplicates(df, "id", "t").collect()}
    assert got == want and len(want) > 800


def test_pairs_of_blocks_meet_once():
    classes = [(c, rows, 100 * c, 100 * c + 99) for c, rows in ((1, 10), (2, 20_000), (3, 5), (4, 9000), (9, 1))]
    placed, cells = nearsets.dealt(classes, 80)
    assert {c: parts for c, _, parts in placed} == {1: 1, 2: 5, 3: 1, 4: 3, 9: 1}
    members = {}
    for block, cell, _ in cells:
        members.setdefault(cell, []).append(block)
    pairs = [tuple(m) for m in members.values()]
    assert len(set(pairs)) == len(pairs) and all(len(m) <= 2 for m in pairs)
    last = {c: first + parts - 1 for c, first, parts in placed}
    assert (last[2], last[3]) in pairs and (last[3], last[4]) in pairs and not any(last[9] in p and last[2] in p for p in pairs)


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for n in (5, 300, 1365, 1366, 4000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = a[: -(-len(a) * 4 // 5)]
        x, y = (nearsets.Side(np.array([0]), np.array([len(s)]), [nearsets.parity(s)]) for s in (a, cut))
        assert len(list(nearsets.close(x, y, False, 80))) == 1
        z = nearsets.Side(np.array([0]), np.array([len(a)]), [nearsets.parity(a + np.uint64(1))])
        assert n < 300 or not list(nearsets.close(x, z, False, 80))
