"""Texts that share word n-grams, and near-duplicate texts by character shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import nearsets


def gram_rows(texts: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, gram: the distinct n-grams of each text."""
    tokens = texts.select(F.col(id_col).alias("id"), text.words(F.col(text_col)).alias("tokens"))
    return tokens.select("id", F.explode(text.grams(F.col("tokens"), n)).alias("gram"))


#: Grams of a test set that are sent to all executors at most (some 100 bytes each).
FEW = 500_000


def overlap_pairs(tests: DataFrame, refs: DataFrame) -> DataFrame:
    """test_id, ref_id, shared (grams in common), example (the smallest) of two sides' gram_rows(). Where
    the tests' grams are few they are sent to the references, whose grams then aren't shuffled."""
    t, r = tests.withColumnRenamed("id", "test_id"), refs.withColumnRenamed("id", "ref_id")
    few = t.limit(FEW + 1).count() <= FEW
    return r.join(F.broadcast(t) if few else t, "gram").groupBy("test_id", "ref_id").agg(F.count("*").alias("shared"), F.min("gram").alias("example"))


def self_overlap_pairs(rows: DataFrame) -> DataFrame:
    """As overlap_pairs() within one side: each pair once, smaller id first. Grams of a single text
    are dropped before the join."""
    several = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    rows = rows.join(several, "gram")
    a, b = rows.withColumnRenamed("id", "test_id"), rows.withColumnRenamed("id", "ref_id")
    return a.join(b, "gram").where("test_id < ref_id").groupBy("test_id", "ref_id").agg(F.count("*").alias("shared"), F.min("gram").alias("example"))


def hit_ids(pairs: DataFrame, both_sides: bool = False) -> DataFrame:
    """Distinct ids of tests with overlap; in a self comparison, of both sides."""
    own = pairs.select(F.col("test_id").alias("id"))
    return (own.union(pairs.select("ref_id")) if both_sides else own).distinct()


def accuracy_by_hit(tests: DataFrame, hits: DataFrame, correct: str = "correct") -> DataFrame:
    """Correct and all tests with and without overlap, from rows (id, correct)."""
    marked = tests.join(hits.withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return marked.groupBy("hit").agg(F.sum(F.col(correct).cast("bigint")).alias("correct"), F.count("*").alias("total"))


def top_pairs(pairs: DataFrame, most: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("shared"), "test_id", "ref_id").limit(most)


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, per_cent: int = 80, k: int = 5) -> DataFrame:
    """a, b, similarity of all pairs whose k-character shingles have a Jaccard similarity of at least
    per_cent / 100: every pair of fitting sizes is compared by bitmaps, and what they leave by the sets."""
    return nearsets.near_pairs(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), per_cent, k)
