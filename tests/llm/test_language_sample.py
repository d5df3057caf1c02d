"""Training where one doc_id is repeated over very many labelled rows."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from evalloom.llm import language_id


def test_repeated_ids_leave_every_language_in(spark, monkeypatch):
    monkeypatch.setattr(language_id, "IN_ALL", 40)
    taken = []
    monkeypatch.setattr(language_id, "Model", lambda x, langs: taken.extend(langs) or SimpleNamespace())
    many = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    same = spark.range(300).select(F.lit(8).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("bb").alias("lang"))
    other = spark.range(9).select("id", F.concat(F.lit("zz "), F.col("id").cast("string")).alias("text"), F.lit("zz").alias("lang"))
    language_id.fit(many.union(same).union(other))
    assert {k: taken.count(k) for k in set(taken)} == {"aa": 13, "bb": 1, "zz": 9}
