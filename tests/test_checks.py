"""Constraints that hold, that give the rows that break them, and that fail; sinks that make rows once."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import numbers
from evalloom.operators import checks, runs
from evalloom.sources import writers


def test_holds(spark):
    n = spark.range(5)
    assert checks.holds(n, F.col("id") < 5, "too large").count() == 5
    with pytest.raises(Exception, match="too large"):
        checks.holds(n, F.col("id") < 3, "too large").collect()


def test_pairs_and_fields(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "b")], "id int, question string, gold string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "c")], "id int, question string, gold string")
    assert [tuple(r) for r in checks.mismatches(a, b, "id", "question", "gold").collect()] == [(2, ["gold"])]
    with pytest.raises(ValueError, match="gold"):
        checks.validated(a, b, "id", "question", "gold")
    assert checks.validated(a, b, "id", "question").count() == 2
    assert checks.paired(a, b.select("id", F.col("gold").alias("other")), "id").count() == 2
    with pytest.raises(ValueError, match="one side"):
        checks.paired(a, b.where("id = 1"), "id")
    with pytest.raises(ValueError, match="repeated"):
        checks.paired(a, b.union(b), "id")
    none = a.limit(0)
    assert checks.paired(none, none.select("id"), "id").count() == 0


def test_run_matrix(spark):
    found = spark.createDataFrame([("r1", "m", 2), ("r2", "m", 2), ("r3", None, 1)], "run string, model string, limit int")
    lines = spark.createDataFrame([("r1",), ("r1",), ("r2",)], "run string")
    state = checks.run_state(found, {"model": "m"}, lines, "run")
    assert {r.run: (r.differing, r.complete) for r in state.collect()} == {"r1": ([], True), "r2": (["lines"], False), "r3": (["model", "lines"], False)}
    planned = spark.createDataFrame([("r1",), ("r4",)], "run string")
    assert [r.run for r in checks.still_to_run(planned, state, "run").collect()] == ["r4"]
    with pytest.raises(ValueError, match="partial"):
        checks.still_to_run(found.select("run"), state, "run")


def test_labels_and_runs(spark):
    sheet = spark.createDataFrame([("1", "", " "), ("2", "logic", "seen"), ("3", None, None)], "doc_id string, category string, note string")
    labels = spark.createDataFrame([("1", "format", "n1"), ("2", "logic", "n2")], "doc_id string, new_category string, new_note string")
    got = {tuple(r) for r in checks.merged_labels(sheet, labels, "doc_id").collect()}
    assert got == {("1", "format", "n1"), ("2", "logic", "seen"), ("3", None, None)}
    with pytest.raises(ValueError, match="contradict"):
        checks.merged_labels(sheet, labels.withColumn("new_category", F.lit("format")), "doc_id")
    facts = spark.createDataFrame([("t", 1, "acc", 1, 0.5), ("t", 1, "acc", 1, 0.5)], "task string, limit int, metric string, seed int, value double")
    assert checks.collapsed(facts).count() == 1
    with pytest.raises(ValueError, match="contradict"):
        checks.collapsed(facts.union(facts.withColumn("value", F.lit(0.25))))
    assert runs.conflicts(facts).count() == 0


def test_sets_and_prompts(spark):
    rows = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1"), ("b", "s1")], "model string, subject string")
    assert [tuple(r) for r in checks.incomplete_sets(rows, "model", "subject").collect()] == [("b", ["s2"])]
    old = spark.createDataFrame([(1, "Question: q"), (2, "Question: r")], "id int, prompt string")
    new = spark.createDataFrame([(1, "Problem: q"), (2, "Problem: R")], "id int, prompt string")
    assert {tuple(r) for r in checks.changed_prompts(old, new, "id", "prompt", "Problem: ", "Question: ").collect()} == {(1, True), (2, False)}


def test_paired_p(spark):
    cases = [(12, 19), (0, 0), (0, 5), (7, 7), (300, 250), (3000, 2000)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint").select("a", "b", numbers.paired_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        n, k = r.a + r.b, min(r.a, r.b)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert math.isclose(r.p, exact, rel_tol=1e-9)


def test_results_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make(frames):
        for f in frames:
            made.add(len(f))
            f["error"] = [None if i % 3 else "e" for i in f["id"]]
            yield f

    rows = spark.range(10).mapInPandas(make, "id bigint, error string")
    writers.split_results(rows, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert made.value == 10
    assert spark.read.json(f"{tmp_path}/good").count() == 6 and spark.read.json(f"{tmp_path}/bad").count() == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad", "good"]
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.markdown(spark.range(4), 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.bars(spark.range(4).select("id", "id"), "id", "id", most=3)
