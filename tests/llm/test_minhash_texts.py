"""Near-dedup sends ids to the texts, so that texts without a candidate are not shuffled, also beyond Spark's threshold."""

import random

import pytest

from evalloom.llm import common, minhash_dedup


@pytest.mark.parametrize("few", [500_000, 0])
def test_texts_without_a_candidate_stay(spark, tmp_path, monkeypatch, few):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        line = list(base)
        for _ in range(rng.randrange(4)):
            line[rng.randrange(40)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(line)))
    rows += [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(1000, 1200)]
    path = str(tmp_path / "alltexts")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    want = {tuple(r) for r in minhash_dedup.near_duplicates(docs, 80).collect()}

    plans, separated = [], minhash_dedup.separated

    def seen(*args):
        out = separated(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString() + "".join(out.inputFiles()))
        return out

    kept, store = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, *more: kept.setdefault(name, []).append(store(df, name, *more)) or kept[name][-1])
    monkeypatch.setattr(minhash_dedup, "separated", seen)
    monkeypatch.setattr(minhash_dedup, "MOST_TURNS", 1)
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {tuple(r) for r in minhash_dedup.near_duplicates(docs, 80).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and plans
    assert all("alltexts" not in p for p in plans)
    assert all(t.where("doc_id >= 1000").count() == 0 for t in kept["texts"])
