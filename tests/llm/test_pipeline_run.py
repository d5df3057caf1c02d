"""All five stages and run() on a small corpus without a single label, each against what it must keep."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline
from evalloom.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    out = {i: "\n".join(line() for _ in range(4)) for i in range(1, 13)}
    out[20] = out[1] + "\n" + line()  # first four lines repeat those of 1
    out[21], out[22], out[23] = "123 !", None, ""
    return out


def test_run_without_labels(spark, tmp_path):
    rows = [(i, t, None, "src0", None if t is None else len(t)) for i, t in texts().items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = pipeline.identify_language(spark, docs, str(tmp_path))
    whole = {i: t for i, t in texts().items() if i not in (21, 22, 23)}
    assert {r.doc_id: r.text for r in told.collect()} == whole

    lines = pipeline.deduplicate_lines(spark, told, str(tmp_path))
    kept, seen = {}, set()
    for i in sorted(whole):  # random lines: those that nearly repeat are those that repeat
        own = [x for x in whole[i].split("\n") if x not in seen]
        seen.update(own)
        kept[i] = "\n".join(own)
    got = {r.doc_id: (r.text.strip("\n"), r.n_chars - len(r.text)) for r in lines.collect()}
    assert got == {i: (t, 0) for i, t in kept.items()}

    copies = spark.createDataFrame([*lines.collect(), (50, kept[3], None, "src0", len(kept[3]))], SCHEMA)
    one = pipeline.deduplicate_documents(spark, copies, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept)

    mixed = pipeline.mix_sources(spark, one, str(tmp_path)).collect()
    assert mixed and {r.doc_id for r in mixed} <= set(kept)
    tokens = packing.Tokens(queries.tokenizer_file(), encode_special_tokens=False)
    want = Counter((r.doc_id, len(tokens(r.text)) // 4 + 1) for r in mixed)
    got = pipeline.pack_sequences(spark, spark.createDataFrame(mixed, SCHEMA), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got) == want
    assert Counter((r.doc_id, r.doc_tokens) for r in pipeline.run(spark, str(tmp_path)).collect()) == want
