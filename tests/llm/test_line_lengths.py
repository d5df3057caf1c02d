"""Line dedup of long lines (more parity bits), of one large group of near copies, and the pipeline's stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from evalloom.llm import line_dedup

from .test_native_ops import removed_lines
from .test_python_ops import frame


def check(spark, rows):
    gone = removed_lines(rows, 80)
    got = line_dedup.remove_repeats(frame(spark, rows)).collect()
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in got} == want
    return gone


def test_long_lines(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (47, 48, 49, 60, 127, 128, 129, 160, 400):
        base = rng.sample(vocabulary, size)
        for changed in (0, size // 20, size // 10, size // 9, size // 8, size // 5):
            line = list(base)
            for k in rng.sample(range(size), changed):
                line[k] = rng.choice(vocabulary)
            rng.shuffle(line)
            n += 1
            rows.append((n, " ".join(line)))
    assert 10 < len(check(spark, rows)) < n


def test_one_large_group(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(300):
        line = list(base)
        for _ in range(rng.randrange(5)):
            line[rng.randrange(14)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(line)))
    assert 100 < len(check(spark, rows)) < 300


def test_stage_drops_what_only_repeats(spark):
    rows = [(1, "a b c d e\nf g h i j"), (2, "f g h i j"), (3, "f g h i j\n\n"), (4, "f g h i j\nk l m"), (5, ""), (6, None), (7, " \n")]
    docs = frame(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("bigint").alias("n_chars"))
    got = {r.doc_id: r.text for r in pipeline.deduplicate_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 4: "k l m", 5: "", 6: None, 7: " \n"}
