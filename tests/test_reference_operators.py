"""Functions and operators on small inputs with known results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import numbers, text
from evalloom.operators import items, overlap, runs
from evalloom.sources import readers, requests, writers
from evalloom.streaming import resume


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_normalize(spark):
    assert one(spark, text.normalize, "2 + 2") == "2  2"
    assert one(spark, text.normalize, "2+2") == "22"
    assert one(spark, text.normalize, "ＡＢ１２　Été, naïve!") == "ab12 été naïve"
    assert one(spark, text.normalize, None) == ""


def test_shingles_and_jaccard(spark):
    assert one(spark, text.shingles, "abcd") == ["abcd"]
    assert one(spark, text.shingles, " !") == []
    assert one(spark, text.shingles, "aaaaaaa") == ["aaaaa"]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]


def test_words_and_grams(spark):
    assert one(spark, text.words, "Straße, snake_case x-1") == ["strasse", "snake_case", "x", "1"]
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],)], "w array<string>")
    assert [r[0] for r in df.select(text.grams(F.col("w"), 2)).collect()] == [["a b", "b a"], []]


def test_extraction(spark):
    assert one(spark, text.strict_answer, "x #### 7 then #### 8") == "7"
    assert one(spark, text.strict_answer, "no") == "[invalid]"
    assert one(spark, text.flexible_answer, "so 3 and then 7.") == "7."
    assert one(spark, text.flexible_answer, "well ..") == ".."
    assert one(spark, text.flexible_answer, "none") == "[invalid]"
    assert one(spark, text.gold_answer, "a #### 1 #### 12 \n") == "12"
    assert one(spark, text.final_answer, "a #### 1\nb ####  2 3\nc") == "2 3"
    assert one(spark, text.canonical_number, "So $1,200 #### 1,200.") == "1200"
    prompt = "Question: a\nAnswer: 1\n\nQuestion: b\nc\nAnswer:"
    assert one(spark, text.questions, prompt) == ["a", "b\nc"]
    with pytest.raises(Exception, match="final answer"):
        one(spark, text.final_answer, "none")


def test_flags_and_cells(spark):
    assert one(spark, text.encoding_flags, "a　b") == ["ideographic space"]
    assert one(spark, text.encoding_flags, "a​  b Ａ") == ["invisible character", "repeated blanks", "mixed width"]
    assert one(spark, text.mojibake, "Õ") and not one(spark, text.mojibake, "O")
    assert one(spark, text.escaped_cell, "a|b\nc") == "a\\|b c"
    assert one(spark, text.cell, "") == "-" and one(spark, text.cell, None) == "-"
    assert one(spark, text.valid_letter, " B ") and not one(spark, text.valid_letter, "C.") and not one(spark, text.valid_letter, None)
    assert one(spark, text.split_list, "a, b ,c") == ["a", "b", "c"]


def test_wilson_and_paired_test(spark):
    df = spark.createDataFrame([(42, 50, 12, 19)], "c bigint, n bigint, up bigint, down bigint")
    low, high = numbers.wilson(F.col("c"), F.col("n"))
    row = df.select(low, high, numbers.paired_p(F.col("up"), F.col("down"))).first()
    assert [round(x, 5) for x in row] == [0.71486, 0.91663, 0.28104]
    none = spark.createDataFrame([(0, 0)], "c bigint, n bigint")
    low, high = numbers.wilson(F.col("c"), F.col("n"))
    assert tuple(none.select(low, high, numbers.binomial_stderr(F.lit(0.5), F.col("n"))).first()) == (None, None, None)


def test_quantile_is_floor_rank(spark):
    df = spark.createDataFrame([([4, 1, 3, 2],), ([],)], "v array<int>")
    assert [tuple(r) for r in df.select(numbers.quantile(F.col("v"), 0.25), numbers.quantile(F.col("v"), 1.0)).collect()] == [(2, 4), (None, None)]


def test_candidate_scores(spark):
    df = spark.createDataFrame([([-1.0, -1.0, -3.0], [1, 2, 9], [True, False, True])], "s array<double>, n array<int>, r array<boolean>")
    row = df.select(numbers.best(F.col("s")), numbers.best_per_length(F.col("s"), F.col("n")), numbers.mass_on(F.col("s"), F.col("r")), *numbers.least(F.transform("s", lambda x: -x))).first()
    e = [math.exp(-1), math.exp(-1), math.exp(-3)]
    assert row[0] == 0 and row[1] == 2 and math.isclose(row[2], (e[0] + e[2]) / sum(e)) and row[3] == 0 and row[4]


def test_canonical_items(spark):
    rows = [(1, "q", "a", " ", "c", "d", "B"), (2, " ", "a", "b", "c", "d", "C."), (3, "q", "a", "b", "c", "d", "9"), (4, "q", "a", "b", "c", "d", None)]
    df = spark.createDataFrame(rows, "id bigint, question string, A string, B string, C string, D string, answer string")
    out = items.canonical(df, "id").orderBy("item_id").collect()
    assert out[0].choices == ["a", "c", "d"] and out[1].question is None
    kinds = {r.item_id: r.kind for r in items.answer_validity(items.canonical(df, "id")).collect()}
    assert kinds == {1: "valid", 2: "malformed", 3: "out_of_range"}
    bad = {r.item_id: r.problems for r in items.problems(df.withColumnRenamed("id", "item_id")).collect()}
    assert bad == {1: ["缺失或空选项"], 2: ["空题干"], 4: ["空答案"]}
    listed = spark.createDataFrame([(1, "q", ["x", "y"], 1), (2, "q", ["x", "y"], 4)], "id int, input string, choices array<string>, label int")
    assert [r.answer for r in items.canonical(listed, "id").orderBy("item_id").collect()] == ["B", "4"]


def test_position_bias(spark):
    rows = [(i, "q", list("wxyz"), a) for i, a in enumerate("AABBBCCCCCCCCCDDDDD")]
    df = spark.createDataFrame(rows, "id int, question string, choices array<string>, answer string")
    got = {r.answer: (r.share, r.suspicious) for r in items.position_bias(items.canonical(df, "id")).collect()}
    assert got == {"A": (10.5, True), "B": (15.8, True), "C": (47.4, True), "D": (26.3, False)}


def test_near_duplicates_and_overlap(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog"), (2, "The quick brown fox jumps over the lazy dog!"), (3, "something else altogether"), (4, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert [tuple(r) for r in overlap.near_duplicates(df, "id", "t").collect()] == [(1, 2, 1.0)]
    pairs = overlap.self_overlap_pairs(overlap.gram_rows(df, "id", "t", 8))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 2, "quick brown fox jumps over the lazy dog")]
    assert sorted(r.id for r in overlap.hit_ids(pairs, True).collect()) == [1, 2]


def test_transitions(spark):
    rows = [(i, i in (1, 2, 3), i in (3, 4), "f") for i in range(6)]
    r = runs.transitions(spark.createDataFrame(rows, "id int, old boolean, new boolean, filter string"), "filter").first()
    assert (r.improved, r.worsened, r.both_correct, r.both_wrong) == (1, 2, 1, 2)
    assert r.improved_ids == [4] and r.worsened_ids == [1, 2] and math.isclose(r.delta_pp, -100 / 6)
    assert r.both_correct + r.worsened == 3 and r.both_correct + r.improved == 2


def test_seed_statistics(spark):
    rows = [("t", 200, "acc", s, v, 0.01, "x") for s, v in enumerate((0.76, 0.75, 0.78, 0.77, 0.775), 1)]
    rows += [("t", 500, "acc", s, 0.7 + s / 1000, None, "x") for s in range(1, 6)] + [("t", 900, "acc", s, 0.7, None, "x") for s in range(1, 5)]
    df = spark.createDataFrame(rows, "task string, limit int, metric string, seed int, value double, stderr double, identity string")
    assert runs.conflicts(df.union(df)).isEmpty()
    stats = runs.seed_statistics(runs.collapsed(df.union(df)))
    got = {r.limit: r for r in stats.collect()}
    assert set(got) == {200, 500} and math.isclose(got[200]["mean"], 0.767) and got[500].mean_stderr is None and math.isclose(got[200]["range"], 0.03)
    assert runs.falling_deviation(stats).first().falls
    assert runs.seed_statistics(df.limit(0)).isEmpty()


def test_merge_resume_and_samples(spark):
    sheet = spark.createDataFrame([(1, "", " "), (2, "logic", "kept")], "doc_id int, category string, note string")
    new = spark.createDataFrame([(1, "format", "n1"), (2, "format", "n2")], "doc_id int, new_category string, new_note string")
    assert [tuple(r) for r in runs.merged_labels(sheet, new, "doc_id").orderBy("doc_id").collect()] == [(1, "format", "n1", False), (2, "logic", "kept", True)]
    ids = spark.range(10)
    assert runs.pending(ids, spark.range(7), "id").count() == 3
    a, b = runs.sample(ids, "id", 4).collect(), runs.sample(ids.repartition(3), "id", 4).collect()
    assert a == b and len({r.id for r in a}) == 4
    assert sorted(runs.draw_indices(100, 50, 42)) == sorted(set(runs.draw_indices(100, 50, 42)))
    done = spark.createDataFrame([(0, 1), (1, 0)], "id bigint, ok int")
    assert runs.complete_accuracy(spark.range(3), done, "id", "ok").first().accuracy is None
    assert runs.complete_accuracy(spark.range(2), done, "id", "ok").first().accuracy == 0.5
    assert runs.only_once(spark.range(3), spark.range(1, 4)).count() == 2


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("﻿" + '{"id": 1, "question": "q", "gold": null}\n\n{"id": 2, "question": "r"}\n', encoding="utf-8")
    assert sorted(r.id for r in readers.jsonl(spark, str(f), readers.SAMPLES).collect()) == [1, 2]
    assert readers.jsonl(spark, str(tmp_path / "none"), readers.SAMPLES).isEmpty()
    assert readers.samples(spark, str(f), 1).count() == 1 and readers.samples(spark, None, 3).count() == 3
    f.write_text('{"id": 1, "question": "q"}\n[1]\nbroken\n')
    assert readers.jsonl(spark, str(f), readers.SAMPLES, strict=False).count() == 1
    assert readers.bad_lines(spark, str(f), readers.SAMPLES).count() == 2
    with pytest.raises(Exception, match="bad line"):
        readers.jsonl(spark, str(f), readers.SAMPLES).collect()
    f.write_text('{"id": 1, "question": "q"}\n{"id": 1, "question": "q"}\n')
    with pytest.raises(ValueError, match="repeated"):
        readers.samples(spark, str(f), 5)


def test_run_results(spark, tmp_path):
    d = tmp_path / "arc" / "seed3_limit200" / "x"
    d.mkdir(parents=True)
    body = {"config": {"model": "hf", "limit": 200, "model_args": {"a": "b"}}, "results": {"arc": {"alias": "arc", "acc,none": 0.5, "acc_stderr,none": 0.01, "f1": "N/A"}}, "date": 1.7e9}
    (d / "results_1.json").write_text(json.dumps(body))
    got = {r.metric: r for r in readers.run_results(spark, str(tmp_path)).collect()}
    assert (got["acc"].task, got["acc"].seed, got["acc"].limit, got["acc"].value, got["acc"].stderr, got["acc"].consistent) == ("arc", 3, 200, 0.5, 0.01, True)
    assert got["f1"].value is None
    (d / "results_2.json").write_text("broken")
    assert readers.probe(spark, str(d)).count() == 2


def test_sheets_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "x"\nb'), ("2", None)], "doc_id string, note string")
    writers.review_sheet(df, str(tmp_path / "s"))
    writers.review_sheet(df, str(tmp_path / "s"))
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "s"), "doc_id string, note string").collect())) == [("1", 'a "x"\nb'), ("2", None)]
    with pytest.raises(ValueError, match="other ids"):
        writers.review_sheet(df.limit(1), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="different"):
        writers.split_results(df, "x", "x/")
    frozen = spark.createDataFrame([(1, 7, "s", "q", "A"), (2, 3, "s", "r", "B")], "id bigint, dataset_index bigint, subject string, question string, gold string")
    m = writers.manifest(frozen, "id", 42, dataset="d").first()
    assert m.selected_indices == [7, 3] and m.subject_counts == {"s": 2} and m["count"] == 2 and len(m.input_sha256) == 64
    assert writers.markdown(frozen.select("id", "gold").orderBy("id")) == "| id | gold |\n|---|---|\n| 1 | A |\n| 2 | B |\n"
    assert writers.bars(frozen, "gold", "id").count("<rect") == 2


def test_requests_retry():
    import urllib.error

    calls, waits = [], []

    def send(url, body, key, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return {"choices": [{"message": {"content": "B"}, "finish_reason": "stop"}], "usage": {"total_tokens": 3, "x": True}}

    out = requests.ask("q", "u", "m", {}, retries=3, backoff=0.5, send=send, sleep=waits.append)
    assert out["answer"] == "B" and out["attempts"] == 3 and waits == [0.5, 1.0] and out["usage"] == {"total_tokens": 3}

    def refused(*_):
        raise urllib.error.HTTPError("u", 400, "no", {}, None)

    assert requests.ask("q", "u", "m", {}, send=refused)["attempts"] == 1
    assert requests.ask("q", "u", "m", {}, send=lambda *_: {})["error_type"] == "MalformedReply"
    assert [requests.retryable(x) for x in (None, 429, 500, 404)] == [True, True, True, False]


def test_resumable_stream(spark, tmp_path):
    src, done, failed, at = (str(tmp_path / x) for x in ("src", "done", "failed", "at"))

    def work(rows):
        return rows.select("id", F.when(F.col("id") % 4 == 0, "bad").alias("error"))

    spark.range(6).repartition(1).write.parquet(src)
    resume.process_new(spark, src, "id bigint", work, done, failed, at)
    spark.range(3, 10).repartition(1).write.mode("append").parquet(src)
    resume.process_new(spark, src, "id bigint", work, done, failed, at)
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == [1, 2, 3, 5, 6, 7, 9]
    assert sorted(r.id for r in spark.read.parquet(failed).collect()) == [0, 4, 4, 8]


def test_entry_without_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 80"], check=True, cwd=__file__.rsplit("/", 2)[0])
