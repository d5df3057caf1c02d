"""Runs compared, summarised over seeds, resumed and sampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def violations(df: DataFrame, bad: Column) -> DataFrame:
    """Rows that break a constraint; none if it holds."""
    return df.where(F.coalesce(bad, F.lit(True)))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def only_once(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks; none if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def pivoted_filters(log: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key with the (smallest) value under each of the two filters; keys that lack one are left out."""
    return log.groupBy(key).pivot("filter", ["flexible-extract", "strict-match"]).agg(F.min(value)).toDF(key, "flexible", "strict").where("flexible is not null and strict is not null")


def transitions(pairs: DataFrame, group: str) -> DataFrame:
    """Of rows (id, old, new, group): counts of the four transitions, difference in points, exact p, and
    the ids that improved and worsened."""
    up, down = ~F.col("old") & F.col("new"), F.col("old") & ~F.col("new")
    ids = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("id"))))
    out = pairs.groupBy(group).agg(
        F.count_if(up).alias("improved"),
        F.count_if(down).alias("worsened"),
        F.count_if(F.col("old") & F.col("new")).alias("both_correct"),
        F.count_if(~F.col("old") & ~F.col("new")).alias("both_wrong"),
        F.count("*").alias("total"),
        ids(up).alias("improved_ids"),
        ids(down).alias("worsened_ids"),
    )
    return out.withColumn("delta_pp", (F.col("improved") - F.col("worsened")) * 100.0 / F.col("total")).withColumn("p", numbers.paired_p(F.col("improved"), F.col("worsened")))


def collapsed(facts: DataFrame) -> DataFrame:
    """Facts (task, limit, metric, seed, value, stderr, identity) once each; those that contradict each
    other stay apart and show in conflicts()."""
    return facts.dropDuplicates()


def conflicts(facts: DataFrame) -> DataFrame:
    return collapsed(facts).groupBy("task", "limit", "metric", "seed").agg(F.count("*").alias("n")).where("n > 1")


def seed_statistics(facts: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Per task, limit and metric with exactly these seeds: n, mean, sample deviation, extremes, range, mean stderr."""
    out = facts.groupBy("task", "limit", "metric").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("seed_sd"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.avg("stderr").alias("mean_stderr"),
        F.array_sort(F.collect_set("seed")).alias("seeds"),
    )
    return out.where(F.col("seeds") == F.array(*[F.lit(s) for s in seeds])).drop("seeds").withColumn("range", F.col("most") - F.col("least"))


def falling_deviation(stats: DataFrame) -> DataFrame:
    """Whether seed_sd falls strictly as the limit grows, where there are several limits."""
    before = F.lag("seed_sd").over(Window.partitionBy("task", "metric").orderBy("limit"))
    return stats.withColumn("before", before).groupBy("task", "metric").agg(F.bool_and(F.when(F.col("before").isNotNull(), F.col("seed_sd") < F.col("before"))).alias("falls"), F.count("*").alias("limits")).where("limits > 1")


def in_first_seen_order(rows: DataFrame, group: str, position: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))


def by_category(rows: DataFrame, category: str, model: str, correct: str, models: Sequence[str], per_cent: bool = True) -> DataFrame:
    """Accuracy of each model by category, and each model's difference to the one before."""
    scale = 100.0 if per_cent else 1.0
    out = rows.groupBy(category).pivot(model, list(models)).agg(F.avg(F.col(correct).cast("double")) * scale)
    for a, b in zip(models, models[1:], strict=False):
        out = out.withColumn(f"{b}_minus_{a}", F.col(f"`{b}`") - F.col(f"`{a}`"))
    return out


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return samples.join(done.select(key), key, "left_anti")


def merged_labels(sheet: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of sheet (key, category, note) filled from labels (key, new_category, new_note): notes that are
    there stay; conflict marks a category that differs from the one given."""
    old = F.nullif(F.trim("category"), F.lit(""))
    return sheet.join(labels, key).select(
        key,
        F.coalesce(old, F.col("new_category")).alias("category"),
        F.coalesce(F.nullif(F.trim("note"), F.lit("")), F.col("new_note")).alias("note"),
        F.coalesce(old != F.col("new_category"), F.lit(False)).alias("conflict"),
    )


def latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def complete_accuracy(samples: DataFrame, results: DataFrame, key: str, match: str) -> DataFrame:
    """Accuracy of samples with results, null while any is missing."""
    rows = samples.join(results, key, "left").agg(F.count("*").alias("samples"), F.count(match).alias("scored"), F.avg(F.col(match).cast("double")).alias("mean"))
    return rows.select("samples", "scored", F.when(F.col("samples") == F.col("scored"), F.col("mean")).alias("accuracy"))


def usage_totals(rows: DataFrame, column: str) -> DataFrame:
    """Sum of each field of a map of whole numbers."""
    return rows.select(F.explode(column).alias("field", "value")).groupBy("field").agg(F.sum("value").alias("total"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that follows from the seed: the draw number and the row."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    drawn = rows.withColumn("draw_key", order).orderBy("draw_key", key).limit(n)
    return drawn.withColumn("draw", F.row_number().over(Window.orderBy("draw_key", key))).drop("draw_key")


def draw_indices(n: int, count: int, seed: int) -> list[int]:
    """The draw without replacement that Python's generator gives for this seed."""
    import random

    return random.Random(seed).sample(range(n), count)


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("turn") <= n)


def reliability(attempts: DataFrame, task: str, ok: str) -> DataFrame:
    """Share of tasks of which all attempts, and of which any attempt, succeed."""
    per = attempts.groupBy(task).agg(F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"))
    return per.agg(F.count("*").alias("tasks"), F.avg(F.col("all_ok").cast("double")).alias("pass_all"), F.avg(F.col("any_ok").cast("double")).alias("pass_any"))
