"""Ids of texts that hold added tokens, against the tokenizers library's default setting."""

import numpy as np
import pytest

from evalloom.llm import packing, queries

public = pytest.importorskip("public_tokenizers")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x\n<|endoftext|>\n\n y  <|endoftext", " <|endoftext|>don't", "plain text", "", "é<|endoftext|> é <|endoftext|>"]


def test_added_tokens():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    own = packing.Tokens(path, encode_special_tokens=False)
    for text in TEXTS:
        assert np.frombuffer(own(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_query_counts_added_tokens(spark, tmp_path):
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.doc_tokens for r in queries.op8_packing(spark, str(tmp_path)).collect()}
    assert got[0] == 5 and got[1] == 2
