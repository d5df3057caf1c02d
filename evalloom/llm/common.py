"""What several operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and the words of all operators, as ASCII ranges.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where none is named, a
    local session (as in tests) gets one of its own; on a cluster that is an error, since a machine's own
    folder would be another one on each executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "evalloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives executors.

    The schema is handed to the reader, so empty tables and all-null columns keep their types. With the
    table written, the driver collects its dead references, on which Spark drops the shuffle files of
    finished steps; else they would lie on the executors' disks until the driver's heap is full.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._evalloom_path = path  # for released()
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of stored() that no returned plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._evalloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as doc_id bigint and text string; others are left out,
    so that no name can clash."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node that each endpoint of edges (a, b) can reach.

    Alternating large-star and small-star steps. Each step is two aggregations to a minimum, which
    combine map-side, and one join; no group is collected, and no step makes more rows than it
    reads, twice over. Null ends and loops are left out. Nodes without an edge aren't returned.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stored(e, "cc")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        after = stored(small, "cc")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        released(e)
        e = after
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
