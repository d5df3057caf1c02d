"""Bands that follow from the threshold."""

import pytest

from evalloom.llm import minhash_dedup as md


@pytest.mark.parametrize("share", [50, 70, 80, 85, 90, 100])
def test_pairs_at_the_threshold_are_rarely_missed(spark, share):
    rows = [(1, "a b c d e f"), (2, "a b c d e g")]
    bands = md.sketches(spark.createDataFrame(rows, "doc_id long, text string"), share=share).first().bands
    per_band = md.M // len(bands)
    assert (1 - (share / 100) ** per_band) ** len(bands) <= 1e-5
    assert len(bands) == 16 or share < 85
