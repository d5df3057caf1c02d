"""op5 takes what its training order holds: copies placed by the inverted demand, range-sorted."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, mixing, queries


@pytest.fixture
def table(spark, tmp_path):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 17 as int))").alias("text"), F.element_at(F.array(*map(F.lit, "aabbc")), (F.col("id") % 5 + 1).cast("int")).alias("source"))
    docs.union(docs.limit(40)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))  # some rows twice
    return str(tmp_path)


def test_op5_reads_its_order(spark, table, monkeypatch):
    seen = {}
    store = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, *more: seen.setdefault(name, store(df, name, *more)))
    rows = queries.op5_mixing(spark, table).collect()
    assert len(rows) == 940
    files = sorted(f for f in seen["mix"].inputFiles())
    at = [x for f in files for x in pq.read_table(f.removeprefix("file://"), columns=["at"])["at"].to_pylist()]
    placed = [x for x in at if x is not None]
    assert placed == sorted(placed) and at[: len(placed)] == placed
    assert sum(r.taken for r in rows) == seen["mix"].where("at is not null").agg(F.sum("size")).first()[0]
    assert len(placed) == sum(r["mix"].copies for r in mixing.planned(spark.read.parquet(f"{table}/documents.parquet")).collect())


def test_taken_follows_the_positions(spark, table, monkeypatch):
    """What gets no time by the inverted demand is not taken."""
    whole = sum(r.taken for r in queries.op5_mixing(spark, table).collect())
    monkeypatch.setattr(mixing, "time_of", lambda share, lean: F.when(share <= 0.5, share))
    half = sum(r.taken for r in queries.op5_mixing(spark, table).collect())
    assert 0.4 * whole < half < 0.6 * whole
