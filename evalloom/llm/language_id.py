"""Language identification in two levels: the family first, then the language within it.

Texts become normalised counts of hashed byte trigrams. One-versus-one linear support vector
machines tell the families apart, and further ones the languages of each family.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textbytes as tb

#: Hashed features; labelled texts that training takes at most from one language, and in all.
BITS, PER_LANGUAGE, IN_ALL = 12, 400, 4000
#: Texts of a piece at most: their feature matrix is what a worker holds.
ROWS = 128

#: ISO 639-1 codes of language families. A language outside is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(column: pa.Array) -> np.ndarray:
    """Rows of unit length, one per text: square roots of trigram counts."""
    data, offsets = tb.laid_out(column)
    n_docs = len(offsets) - 1
    data = tb.LOWER[data].astype(np.uint32)
    if len(data) < 3:
        return np.zeros((n_docs, 1 << BITS), dtype=np.float32)
    code = (((data[:-2] << 16) | (data[1:-1] << 8) | data[2:]) * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))[:-2]
    inside = np.arange(len(code)) + 3 <= offsets[doc + 1]
    counts = np.bincount((doc * (1 << BITS) + code)[inside], minlength=n_docs << BITS)
    x = np.sqrt(counts.reshape(n_docs, 1 << BITS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, weight: float = 1e-4) -> np.ndarray:
    """A linear machine for y = +1 or -1 under the squared hinge loss, by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = before = np.zeros(x.shape[1], dtype=np.float32)
    for i in range(rounds):
        at = w + i / (i + 3) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ at))
        before, w = w, at - 0.2 * (weight * at - 2 * x.T @ (share * y * slack)).astype(np.float32)
    return w


class Model:
    """labels; machines: for "" (families) and each family the names and pairwise weights."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.labels = sorted(set(langs))
        langs = np.array(langs, dtype=object)
        family = np.array([FAMILY.get(z, z) for z in langs], dtype=object)
        self.levels = {"": self._level(x, family)}
        for name in self.levels[""][0]:
            self.levels[f"/{name}"] = self._level(x[family == name], langs[family == name])

    @staticmethod
    def _level(x, y):
        names = sorted(set(y))
        weights = []
        for a, b in combinations(names, 2):
            use = (y == a) | (y == b)
            weights.append(_machine(x[use], np.where(y[use] == a, 1, -1).astype(np.float32)))
        return names, np.array(weights, dtype=np.float32).reshape(len(weights), -1)

    @staticmethod
    def _choose(x, level):
        names, weights = level
        chance = np.zeros((len(x), len(names)))
        if len(names) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margins = x @ weights[:, :-1].T + weights[:, -1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        for k, (a, b) in enumerate(combinations(range(len(names)), 2)):
            chance[:, a] += sure[:, k]
            chance[:, b] += 1 - sure[:, k]
        best = chance.argmax(1)
        return best, chance[np.arange(len(x)), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, score = np.empty(len(x), dtype=object), np.ones(len(x))
        names = self.levels[""][0]
        best, score = self._choose(x, self.levels[""])
        for i, name in enumerate(names):
            of = np.flatnonzero(best == i)
            if len(of):
                level = self.levels[f"/{name}"]
                inner, sure = self._choose(x[of], level)
                out[of] = np.array(level[0], dtype=object)[inner]
                score[of] *= sure
        return out, score


def _bounded(batches, text="text"):
    for whole in batches:
        for piece in tb.pieces(whole, text, tb.SMALL):
            for i in range(0, piece.num_rows, ROWS):
                yield piece.slice(i, ROWS)


def _sampled(batches):
    for b in _bounded(batches):
        yield pa.record_batch([b.column("lang"), pa.array([z.tobytes() for z in features(b.column("text"))], pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang): of each language the PER_LANGUAGE texts with the least hash of
    doc_id (equal rows count once), fewer if there are so many languages that the sample would pass IN_ALL. None without labels."""
    labelled = labelled.where("lang is not null and text is not null")
    named = labelled.select("doc_id", "lang")
    n = named.select(F.countDistinct("lang")).first()[0]
    if not n:
        return None
    most = max(1, min(PER_LANGUAGE, IN_ALL // n))
    labelled = labelled.select("doc_id", "lang", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    chosen = labelled.select("doc_id", "lang", "key").distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    ids = F.broadcast(chosen.drop("i"))  # IN_ALL rows at most, or a row a language
    same = (labelled["doc_id"].eqNullSafe(ids["doc_id"])) & (labelled["lang"] == ids["lang"]) & (labelled["key"] == ids["key"])
    rows = labelled.join(ids, same, "left_semi").dropDuplicates(["doc_id", "lang", "key"]).select("lang", "text").mapInArrow(_sampled, "lang string, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(len(rows), -1), [r["lang"] for r in rows])


def _letters(column: pa.Array) -> np.ndarray:
    data, offsets = tb.laid_out(column)
    low = tb.LOWER[data]
    plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    has = plain[offsets[1:]] > plain[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~has & (high[offsets[1:]] > high[offsets[:-1]])):
        has[i] = any(c.isalpha() for c in column[i].as_py())
    return has


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, and lang_pred and score (0 to 1), which replace any of these
    names. Null texts, texts without a letter and, where nothing was learned, all texts are "und" with
    score 0. Ties go to the name that sorts first. Texts of any length are read whole; only they count."""
    docs = docs.drop("lang_pred", "score").withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (labels choose 2) rows of 2**BITS weights

    def run(batches):
        m = shared.value
        for b in _bounded(batches, text_col):
            texts = b.column(text_col)
            lang, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
            use = np.flatnonzero(_letters(texts))
            if m is not None and len(use):
                lang[use], score[use] = m.predict(features(texts.take(pa.array(use))))
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*b.schema.names, "lang_pred", "score"])

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, with all columns."""

    def run(batches):
        for b in _bounded(batches, text_col):
            yield b.filter(pa.array(_letters(b.column(text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame) -> Model | None:
    """A model from all documents but the held-out ones (crc32(doc_id as text) mod 5 = 0)."""
    return fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").where(common.remainder(F.col("doc_id")) != 0))
