"""Resumable batches as Structured Streaming queries. (Streams are an addition of this library.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, work, done_path: str, failed_path: str, checkpoint: str, key: str = "id") -> None:
    """Run work (DataFrame -> DataFrame with a column error) on rows of new files at source that aren't
    done yet; successes are appended to done_path, failures to failed_path. Calling it again goes on
    where it stopped: files are tracked by the checkpoint, keys by what is done."""

    def batch(rows: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(done_path).select(key)
            rows = rows.join(done, key, "left_anti")
        except Exception as e:
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
        out = work(rows.dropDuplicates([key])).persist()
        out.where("error is null").drop("error").write.mode("append").parquet(done_path)
        out.where("error is not null").write.mode("append").parquet(failed_path)
        out.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events by type and window of event time; rows later than `late` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
