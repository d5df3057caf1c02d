"""Sources mixed to target weights along a time-varying curriculum; DataFrame operations only.

Every source's weight is a schedule over the training time 0 to 1, linear here. Its integral sets
the source's share of tokens. The cumulative demand up to a time, inverted, gives each document the
time at which its turn comes; documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order, repeating; how each weight's schedule leans, from
#: -1 (falls to nothing) to 1 (rises from nothing).
WEIGHTS, LEANS = (5, 2, 1), (-0.5, 0.0, 0.5)
#: Leading hex digits of a document's hash: parts in which a source's documents are ordered.
DIGITS = 3


def size(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, leans: Sequence[float] = LEANS, most: float = 3) -> DataFrame:
    """source, source_size, target, lean from rows (source, source_size): all tokens, shared by weight,
    no target above `most` times its source; the excess goes to the others by weight. Sources take
    the weights in code-point order, null last. Works on one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    turn = (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")
    s = sizes.withColumn("turn", turn)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn"))).withColumn("lean", F.element_at(F.array(*map(F.lit, leans)), F.col("turn")))
    s = s.withColumn("top", F.lit(most) * F.col("source_size"))
    # Sources reach their top in the order of top / weight: with the first k at theirs, the others get a level by weight.
    filling = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double"))
    s = s.withColumn("place", F.row_number().over(filling)).withColumn("fits", F.col("level") * F.col("weight") <= F.col("top"))
    s = s.withColumn("first", F.min(F.when(F.col("fits"), F.col("place"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("top").cast("double"), F.col("level") * F.col("weight")).alias("target"), "lean")


def time_of(share: Column, lean: Column) -> Column:
    """When a source with the schedule 1 + lean (2t - 1) has given that share of its tokens."""
    a, b = lean, 1 - lean
    root = F.try_divide(F.sqrt(b * b + 4 * a * share) - b, 2 * a)
    return F.when(lean == 0, share).otherwise(root)


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, size_col: str | None, **options) -> DataFrame:
    """row, a struct with all columns of docs, and mix; see planned()."""
    n = F.col(f"`{size_col}`").cast("bigint") if size_col else size(F.col(f"`{text_col}`"))
    source, doc_id = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    # Plain equality of two columns, so that the window and the join lay the rows out in the same way and texts travel once.
    keys = (F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("no_name"), F.substring(digest, 1, DIGITS).alias("part"))
    key = ["name", "no_name", "part"]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), n.alias("size"), doc_id.alias("id"), digest.alias("hash"), *keys)
    parts = common.stored(row.groupBy("source", *key).agg(F.sum("size").alias("n")), "parts")
    aim = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), **options).withColumnRenamed("source", "s")
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(along), F.lit(0))).join(aim, F.col("source").eqNullSafe(F.col("s"))).drop("source", "s", "n")
    inside = Window.partitionBy(*key).orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    row = row.drop("source").withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, key)
    begin = F.col("ahead") + F.col("within")
    # A copy's place is the demand before its middle; the inverted demand gives it a time while its place lies
    # within the target: in every whole round, and in the last one as far as that goes.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(F.lit(0)).cast("bigint")
    end = F.greatest(F.col("target"), (rounds * F.col("source_size")).cast("double"))

    def time(turn: Column) -> Column:
        place = begin + F.col("size") / 2 + turn * F.col("source_size")
        asked = (F.col("target") > 0) & (place <= end) & ((turn < rounds) | (F.col("size") > 0))
        return F.when(asked, time_of(F.least(F.lit(1.0), F.try_divide(place, F.col("target"))), F.col("lean")))

    times = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), rounds), time), lambda t: t.isNotNull())
    row = row.withColumn("times", times)
    mix = F.struct(
        "size",
        F.col("source_size"),
        F.col("target"),
        (F.col("size") * F.size("times")).cast("bigint").alias("taken"),
        F.size("times").cast("bigint").alias("copies"),
        F.get("times", F.lit(0)).alias("position"),
        F.col("lean"),
        F.col("times"),
    )
    return row.select("row", mix.alias("mix"))


def _ordered(plan: DataFrame, turns: Column) -> DataFrame:
    """row, mix, at: a row for each time of turns (an explode), range-sorted by it."""
    # A second key lets equal positions lie in several ranges.
    return plan.select("row", "mix", turns.alias("at")).withColumn("tie", F.xxhash64("row")).orderBy(F.col("at").asc_nulls_last(), "tie")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, **options) -> DataFrame:
    """docs with a column `mix`: size, source_size, target, taken, copies, position (of the first copy; null
    if there is none), lean, times (the positions of all copies).

    A source's documents stand in the order of their hash, over and over, until its target is met; a
    copy's place in that order is a demand of tokens, and the schedule inverted there its position.
    Copies to which the inverted demand gives a position are taken: those whose place lies within the
    target, so the last round stops with the document that the target falls in the first half of or
    before. Each document is taken whole, floor(target / source_size) times or once more.

    A hot source is ordered in 16**DIGITS parts: sums of parts first, then documents within a part.
    Null texts and texts without words have size 0; null sources are a source; rows alike in doc_id
    and size may stand for each other. No rows give no rows. Columns of docs are kept as they are;
    one named mix is replaced.
    """
    plan = _planned(docs, id_col, text_col, source_col, size_col, **options)
    return plan.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "mix"], "mix")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position, with
    columns as in docs, whatever their names. Rows without words aren't taken in a last, partial round."""
    plan = _planned(docs, id_col, text_col, source_col, size_col, **options)
    placed = _ordered(plan, F.explode("mix.times"))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, **options) -> DataFrame:
    """The rows of mixed() in training order, with `mix` as in planned() and `at`, the position of this copy.
    Rows of which no copy is taken stand once at the end, with a null position. Columns of docs named mix or at
    are replaced."""
    plan = _planned(docs, id_col, text_col, source_col, size_col, **options)
    placed = _ordered(plan, F.explode_outer("mix.times"))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix", "at")], "mix", "at")
