"""Texts that share word n-grams: only recurring grams are dealt out, and lists of texts in place of gram pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import sharedgrams


def planted():
    rng = random.Random(2)
    word = lambda: rng.choice("été Straße the of an ox x1 _y 𠀀".split()) + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(30)]
    for t in texts[:12]:
        at, start = rng.randrange(len(t)), rng.randrange(10)
        t[at:at] = passage[start : start + rng.randrange(5, 20)]
    texts += [texts[0], texts[0][:-1], passage[:7], passage[:8], ["a"] * 20, ["a"] * 9]
    return [" ".join(t) for t in texts] + ["", None]


def grams(t, n):
    w = t.split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_pairs_and_examples(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(planted())), "id int, t string")
    words = {r.id: r.w for r in df.select("id", F.array_join(text.words(F.col("t")), " ").alias("w")).collect()}
    for n, most in ((8, 512), (13, 512), (8, 3)):
        monkeypatch.setattr(sharedgrams, "LIST", most)
        of = {i: grams(w, n) for i, w in words.items()}
        want = {(a, b): (len(of[a] & of[b]), min(of[a] & of[b], key=str.encode)) for a in of for b in of if a < b and of[a] & of[b]}
        found = sharedgrams.with_examples(sharedgrams.pairs(df, n), df, n)
        assert {(r.test_id, r.ref_id): (r.shared, r.example) for r in found.collect()} == want and len(want) > 3
    assert {r.id for r in sharedgrams.hit_ids(df, 8).collect()} == {i for p in want for i in p}
    equal = {(a, b) for a, b in want if words[a] == words[b]}
    assert {tuple(r) for r in sharedgrams.equal_pairs(df, 8).collect()} == equal and equal


def test_passage_in_all_texts_is_one_list(spark):
    """100 texts with 40 grams in common: one list, where a join on grams made 198,000 rows."""
    passage = " ".join(f"p{i}" for i in range(52))
    df = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(100)], "id int, t string")
    (row,) = sharedgrams.lists(df, 13).collect()
    assert row.docs == list(range(100)) and row.grams == 40


def test_few_anchors_and_the_same_everywhere():
    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    all_ = sharedgrams.anchors(h, 13)
    assert len(all_) == 4988 and len(np.unique(all_)) < 1600
    assert np.array_equal(sharedgrams.anchors(h[100:200], 13), all_[100:188])


def test_python_gets_only_rare_texts(spark):
    """NFKC and folding by ICU equal Python's; the worker gets null for each text but those with unassigned characters."""
    import unicodedata

    marks = ["ệ", "ﬁ①Ａ", "ẞßİ", "한글", "각", "̈́ẛ̣", "\U0001d49c", "Ǆ", "\U0001ccd6A", "͸é", "plain", None]
    df = spark.createDataFrame([(t,) for t in marks], "t string")
    for r in df.select("t", text.nfkc(F.col("t")).alias("n"), text.folded(F.col("t")).alias("f")).collect():
        assert r.t is None and r.n is None or (r.n, r.f) == (unicodedata.normalize("NFKC", r.t), unicodedata.normalize("NFKC", r.t).casefold())
    plan = df.select(text.folded(F.col("t")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "reflect" in plan.lower() or "CallMethodViaReflection" in plan
