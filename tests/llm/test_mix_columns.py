"""Mixing keeps columns of any name, and shared folders are never one machine's own on a cluster."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, mixing


def test_clashing_names(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 3)").alias("text"), F.lit("s").alias("source"))
    own = ("turn", "mix", "at", "tie", "row", "part", "name", "share", "size")
    for c in own:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    got = mixing.mixed(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == 40 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in own)
    assert all(r["size"] == f"size{r.doc_id}" for r in mixing.planned(df).collect())


def test_no_machine_local_folder():
    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default: folder, set=lambda key, value: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://x:7077", "hdfs://shared/")) == "hdfs://shared"
    assert common.shared_dir(session("local[2]", None))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session("spark://x:7077", None))
