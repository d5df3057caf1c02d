"""Text normalisation and extraction as Columns. NFKC and case folding are those of Spark's own ICU library; Arrow
UDFs are left for texts with characters that the JVM's Unicode doesn't know."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of words, answer patterns and flags whose results must equal published ones.
WORD = r"[\p{L}\p{N}_]+"
STRICT_ANSWER = r"#### (\-?[0-9\.\,]+)"
FLEXIBLE_ANSWER = r"(-?[$0-9.,]{2,})|(-?[0-9]+)"
INVALID = "[invalid]"
QUESTIONS = r"(?ms)^Question: (.*?)\nAnswer:"
LETTERS = "ABCDEF"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _beyond_ascii(t: Column) -> Column:
    return t.rlike(r"[^\x00-\x7F]")


def _unassigned(t: Column) -> Column:
    """Whether ICU and Python may differ: on characters that only one of them knows. What the JVM's Unicode has is
    in both, and for such characters normalisation and folding never change."""
    return t.rlike(r"\p{Cn}")


def _icu(t: Column, fold: bool) -> Column:
    out = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), out, F.lit(True)) if fold else out


def _by_icu(t: Column, udf, fold: bool, ascii: Column) -> Column:
    """Of one text at a time, so no batch of texts is held: Python gets nulls for all but the rare ones."""
    rare = F.coalesce(_beyond_ascii(t) & _unassigned(t), F.lit(False))
    return F.when(rare, udf(F.when(rare, t))).when(_beyond_ascii(t), _icu(t, fold)).otherwise(ascii)


def nfkc(t: Column) -> Column:
    """NFKC; plain ASCII stays as it is."""
    return _by_icu(t, _nfkc, False, t)


def folded(t: Column) -> Column:
    """NFKC and full case folding."""
    return _by_icu(t, _nfkc_fold, True, F.lower(t))


def strip(t: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def blank(t: Column) -> Column:
    """Null or nothing but white space."""
    return t.isNull() | (strip(t) == "")


def normalize(t: Column) -> Column:
    """NFKC, lower case, white space to one space, then punctuation off, then trimmed; null is empty."""
    spaced = F.regexp_replace(F.lower(nfkc(F.coalesce(t, F.lit("")))), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", ""))


def shingles(t: Column, k: int = 5) -> Column:
    """Distinct k-character pieces of the normalised text; a shorter text is its own, a blank one has none."""
    n = normalize(t)
    return F.when(F.length(n) >= k, F.array_distinct(F.regexp_extract_all(n, F.lit(rf"(?s)(?=(.{{{k}}}))"), 1))).when(n != "", F.array(n)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def words(t: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(t, F.lit(""))), F.lit(WORD), 0)


def grams(tokens: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces; none if there are fewer words. tokens is a column of
    the table (a lambda can't hold the UDF in words())."""
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def strict_answer(response: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(response, STRICT_ANSWER, 1), F.lit("")), F.lit(INVALID))


def flexible_answer(response: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(response, F.lit(FLEXIBLE_ANSWER), 0), F.lit(-1)), F.lit(INVALID))


def gold_answer(target: Column) -> Column:
    return strip(F.substring_index(target, "####", -1))


def final_answer(solution: Column) -> Column:
    """After the last ####; a solution without one is an error."""
    found = F.try_element_at(F.regexp_extract_all(solution, F.lit(r"####\s*([^\n]+)"), 1), F.lit(-1))
    return F.when(found.isNull(), F.raise_error(F.lit("solution without final answer"))).otherwise(found)


def questions(prompt: Column) -> Column:
    return F.regexp_extract_all(prompt, F.lit(QUESTIONS), 1)


def canonical_number(t: Column) -> Column:
    """Lower case; commas, dollar signs, everything up to the last '#### ' and a final dot go."""
    out = F.regexp_replace(F.regexp_replace(t, r"[,$]", ""), r"(?s).*#### ", "")
    return F.lower(F.regexp_replace(out, r"\.$", ""))


def valid_letter(answer: Column) -> Column:
    return F.coalesce(strip(answer).rlike("^[ABCD]$"), F.lit(False))


def mcq_prompt(question: Column, choices: Column) -> Column:
    """Question, four lettered choices and the call for an answer."""
    lettered = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit("ABCD"), i + 1, 1), F.lit(". "), strip(c)))
    return F.concat_ws("\n", strip(question), F.array_join(lettered, "\n"), F.lit("Answer:"))


def encoding_flags(t: Column) -> Column:
    """Which of four encoding problems a text has."""
    return F.array_compact(
        F.array(
            F.when(t.contains("　"), F.lit("ideographic space")),
            F.when(t.rlike("[​-‏﻿]"), F.lit("invisible character")),
            F.when(t.rlike(r"[ \t]{2,}"), F.lit("repeated blanks")),
            F.when(t.rlike("[Ａ-Ｚａ-ｚ０-９]") & t.rlike("[A-Za-z0-9]"), F.lit("mixed width")),
        )
    )


def mojibake(t: Column) -> Column:
    return t.contains("Õ") | t.contains("�")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", F.try_divide(part * 100.0, whole)))


def escaped_cell(t: Column, most: int = 120) -> Column:
    return F.left(F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(most))


def cell(t: Column) -> Column:
    return F.coalesce(F.nullif(t.cast("string"), F.lit("")), F.lit("-"))


def split_list(t: Column) -> Column:
    return F.transform(F.split(t, ","), lambda x: F.trim(x))


def run_id(epoch: Column) -> Column:
    """yyyyMMdd-HHmmss and four hex digits that follow from the time."""
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.md5(epoch.cast("string").cast("binary")), 1, 4))


def commit_id(t: Column) -> Column:
    return F.coalesce(t.rlike("^[0-9a-f]{40}$"), F.lit(False))
