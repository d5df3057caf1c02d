"""The stages on the smallest tables: what each keeps, and gapless sequences at the end."""

from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(90001, "123 !", "en", "src0", 5), (90002, None, "en", None, None)], docs.schema)
    docs = spark.createDataFrame(docs.union(extra).collect(), docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    told = pipeline.identify_language(spark, docs, SF)
    assert told.columns == list(pipeline.COLUMNS) and {r.doc_id for r in told.collect()} == ids - {90001, 90002}
    mixed = pipeline.mix_sources(spark, told, SF)
    assert mixed.columns == list(pipeline.COLUMNS) and mixed.count() > 0
    by = defaultdict(list)
    for r in pipeline.pack_sequences(spark, told, SF).collect():
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
