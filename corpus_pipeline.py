"""Documents to packed sequences: language ID, line dedup, near-dedup, mixing and packing.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common, language_id, line_dedup, minhash_dedup, mixing, packing, queries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, or no letter) go; these alone go where no
    label is left to learn from."""
    model = language_id.trained(docs)
    if model is None:
        return language_id.with_letters(docs.select(*COLUMNS))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one leave the text; n_chars follows. Documents that lose a line
    and have no word left go, as they only repeat others; those without words from the start stay."""
    out = line_dedup.remove_repeats(docs.select(*COLUMNS), 80)
    left = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""
    out = out.where((F.col("n_removed") == 0) | left)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.one_of_each(docs.select(*COLUMNS), 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_file(), 2048, encode_special_tokens=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("minhash_near_dedup", deduplicate_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, learned models and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = common.stored(docs, name)
    return docs
