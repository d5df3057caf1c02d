"""Constraints over runs, results and labels: what breaks them as rows, and the forms that fail.

Functions named after what they return give the offending rows; those that take the place of the
data raise instead: holds() when a row is read, the others before they return.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs


def holds(df: DataFrame, good: Column, message: str) -> DataFrame:
    """df; reading a row for which good isn't true raises the message."""
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _raise_if_any(bad: DataFrame, message: str) -> None:
    some = [str(r.asDict()) for r in bad.take(3)]
    if some:
        raise ValueError(f"{message}: {'; '.join(some)}")


def mismatches(a: DataFrame, b: DataFrame, key: str, *fields: str) -> DataFrame:
    """key and differing, the fields (in order) whose values differ, null-safely, between rows of a and b with that key."""
    right = b.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return a.join(right, F.col(key) == F.col("_key")).select(key, differing.alias("differing")).where(F.size("differing") > 0)


def orphans(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side of the keys that only one of a and b has."""
    keys = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    return keys.where("in_a is null or in_b is null").select(key, F.when(F.col("in_b").isNull(), "left").otherwise("right").alias("side"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a joined with b, one row a key; keys that only one side has, or that repeat, are an error."""
    _raise_if_any(orphans(a, b, key), "keys of one side only")
    for side in (a, b):
        _raise_if_any(runs.repeated_keys(side, key), "repeated keys")
    return a.join(b, key)


def validated(a: DataFrame, b: DataFrame, key: str, *fields: str) -> DataFrame:
    """Rows of a whose key is in b; any field that differs there is an error."""
    _raise_if_any(mismatches(a, b, key, *fields), "rows that don't belong together")
    return a.join(b.select(key).distinct(), key, "left_semi")


def run_state(found: DataFrame, expected: Mapping[str, object], lines: DataFrame, key: str, limit: str = "limit") -> DataFrame:
    """key, differing (the expected fields that differ, and 'lines' where the log has not as many lines
    as the run's limit) and complete, for every row of found; lines holds a row (key) per line."""
    counts = lines.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_lines"))
    rows = found.join(counts, F.col(key) == F.col("_key"), "left")
    wrong = [F.when(~F.col(f).eqNullSafe(F.lit(v)), F.lit(f)) for f, v in expected.items()]
    wrong.append(F.when(~F.coalesce("_lines", F.lit(0)).eqNullSafe(F.col(limit).cast("bigint")), F.lit("lines")))
    return rows.select(key, F.array_compact(F.array(*wrong)).alias("differing")).withColumn("complete", F.size("differing") == 0)


def still_to_run(planned: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of planned without a complete run; output that is there but not complete is an error, so that
    nothing is run over it."""
    _raise_if_any(planned.join(state.where(~F.col("complete")), key).select(key, "differing"), "partial output")
    return planned.join(state, key, "left_anti")


def incomplete_sets(rows: DataFrame, group: str, member: str) -> DataFrame:
    """group and missing: members that other groups have and this one lacks."""
    have = rows.select(group, member).distinct()
    wanted = have.agg(F.collect_set(member).alias("all"))  # the members' names, such as 57 subjects
    own = have.groupBy(group).agg(F.collect_set(member).alias("own"))
    return own.join(F.broadcast(wanted)).select(group, F.sort_array(F.array_except("all", "own")).alias("missing")).where(F.size("missing") > 0)


def changed_prompts(old: DataFrame, new: DataFrame, key: str, prompt: str, variant: str, original: str) -> DataFrame:
    """key, same: whether the new prompt, its variant label put back to the original, is the old one."""
    right = new.select(F.col(key).alias("_key"), F.col(prompt).alias("_new"))
    return old.join(right, F.col(key) == F.col("_key")).select(key, (F.replace("_new", F.lit(variant), F.lit(original)) == F.col(prompt)).alias("same"))


def merged_labels(sheet: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The sheet filled from labels, rows without a label included; a label that contradicts an earlier one is an error."""
    merged = runs.merged_labels(sheet, labels, key)
    _raise_if_any(merged.where("conflict").select(key, "category"), "labels that contradict earlier ones")
    rest = sheet.join(labels.select(key), key, "left_anti").select(key, "category", "note")
    return merged.drop("conflict").unionByName(rest)


def collapsed(facts: DataFrame) -> DataFrame:
    """Facts once each; repeated runs that contradict each other are an error."""
    _raise_if_any(runs.conflicts(facts), "runs that contradict each other")
    return runs.collapsed(facts)
