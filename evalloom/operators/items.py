"""Multiple-choice items in one form, and the audit of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

#: Names under which items hold their question and answer, in order of preference.
QUESTION_KEYS = ("question", "input", "prompt", "text")
ANSWER_KEYS = ("answer", "label", "target", "gold", "correct")


def _first(df: DataFrame, names) -> Column:
    own = [F.col(c).cast("string") for c in names if c in df.columns]
    return F.coalesce(*[F.when(~text.blank(c), c) for c in own], F.lit(None).cast("string")) if own else F.lit(None).cast("string")


def canonical(df: DataFrame, id_col: str) -> DataFrame:
    """item_id, question, choices, answer from either form: a list of choices, or columns A to F of
    which blank ones are left out (so that letters move up); whole-number answers become letters."""
    types = dict(df.dtypes)
    if types.get("choices", "").startswith("array"):
        choices = F.transform("choices", lambda c: c.cast("string"))
    else:
        own = [F.col(c).cast("string") for c in text.LETTERS if c in df.columns]
        choices = F.filter(F.array(*own), lambda c: ~text.blank(c)) if own else F.array().cast("array<string>")
    df = df.withColumn("choices_", F.coalesce(choices, F.array().cast("array<string>")))
    answers = []
    for c in ANSWER_KEYS:
        if c in df.columns:
            value = F.col(c).cast("string")
            if types[c] in ("int", "bigint", "smallint", "tinyint"):
                inside = (F.col(c) >= 0) & (F.col(c) < F.size("choices_"))
                value = F.when(inside, F.substring(F.lit(text.LETTERS), F.col(c).cast("int") + 1, F.lit(1))).otherwise(value)
            answers.append(F.when(~text.blank(value), text.strip(value)))
    answer = F.coalesce(*answers, F.lit(None).cast("string")) if answers else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("bigint").alias("item_id"), _first(df, QUESTION_KEYS).alias("question"), F.col("choices_").alias("choices"), answer.alias("answer"))


def exact_duplicates(items: DataFrame) -> DataFrame:
    """Groups of items alike in question, choices and answer (nulls alike): first id, size, ids in order."""
    return (
        items.groupBy("question", "choices", "answer")
        .agg(F.min("item_id").alias("first_id"), F.count("*").alias("n"), F.sort_array(F.collect_list("item_id")).alias("ids"))
        .where("n > 1")
        .select("first_id", "n", "ids")
    )


def problems(rows: DataFrame, letters: str = "ABCD") -> DataFrame:
    """item_id and what is missing of rows (item_id, question, A to D, answer)."""
    empty = F.lit(False)
    for c in letters:
        empty = empty | text.blank(F.col(c))
    found = F.array_compact(
        F.array(
            F.when(text.blank(F.col("question")), F.lit("空题干")),
            F.when(empty, F.lit("缺失或空选项")),
            F.when(text.blank(F.col("answer")), F.lit("空答案")),
        )
    )
    return rows.select("item_id", found.alias("problems")).where(F.size("problems") > 0)


def breakdown(found: DataFrame, column: str = "problems") -> DataFrame:
    return found.select(F.explode(column).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def answer_validity(items: DataFrame) -> DataFrame:
    """item_id and kind (valid, malformed, out_of_range); items without answer or choices are left out."""
    letters = F.slice(F.split(F.lit(text.LETTERS), ""), F.lit(1), F.size("choices"))
    tidy = F.upper(F.regexp_replace("answer", r"\.+$", ""))
    kind = F.when(F.array_contains(letters, F.col("answer")), "valid").when(F.array_contains(letters, tidy), "malformed").otherwise("out_of_range")
    return items.where(F.col("answer").isNotNull() & (F.size("choices") > 0)).select("item_id", kind.alias("kind"), "answer")


def position_bias(items: DataFrame, most: float = 5.0) -> DataFrame:
    """Share of each valid answer letter; suspicious if it is more than `most` points off an even share."""
    counts = answer_validity(items).where("kind = 'valid'").groupBy("answer").agg(F.count("*").alias("n")).cache()
    whole = F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("letters")))  # one row
    share = F.bround(F.col("n") * 100.0 / F.col("total"), 1)
    expected = F.lit(100.0) / F.col("letters")
    return counts.join(whole).select("answer", "n", share.alias("share"), expected.alias("expected"), (F.abs(share - expected) > most).alias("suspicious"))


def length_summary(lengths: DataFrame, column: str = "length") -> DataFrame:
    """One row: floor-rank quantiles, mean and IQR bounds, from the histogram of lengths, which is as
    small as the longest text however many rows there are."""
    hist = lengths.groupBy(column).agg(F.count("*").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col(column).alias("v"), "k"))).alias("h"), F.sum("k").alias("n"), F.sum(F.col(column) * F.col("k")).alias("total"))
    running = F.aggregate("h", F.array().cast("array<struct<v:bigint,upto:bigint>>"), lambda a, x: F.concat(a, F.array(F.struct(x["v"].cast("bigint").alias("v"), (F.coalesce(F.try_element_at(a, F.lit(-1))["upto"], F.lit(0)) + x["k"]).alias("upto")))))

    def at(q: float) -> Column:
        rank = F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1)
        return F.element_at(F.filter("r", lambda x: x["upto"] > rank), 1)["v"]

    out = hist.withColumn("r", running)
    out = out.select("n", at(0.0).alias("least"), at(0.01).alias("p01"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), at(0.99).alias("p99"), F.element_at("h", -1)["v"].cast("bigint").alias("most"), (F.col("total") / F.col("n")).alias("mean"))
    iqr = F.col("q3") - F.col("q1")
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("q1") - 1.5 * iqr)).withColumn("high", F.col("q3") + 1.5 * iqr)


def length_outliers(rows: DataFrame, id_col: str, column: str = "length") -> DataFrame:
    """Rows whose length lies outside the IQR bounds (empty ones aren't short)."""
    bounds = F.broadcast(length_summary(rows, column).select("low", "high"))  # one row
    kind = F.when(F.col(column) > F.col("high"), "long").when((F.col(column) > 0) & (F.col(column) < F.col("low")), "short")
    return rows.join(bounds).select(id_col, column, kind.alias("kind")).where("kind is not null")
