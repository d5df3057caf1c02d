"""License texts found through a positional index of rare words.

Each template is a word sequence with key phrases that must stand in it. The index holds, for the
highest-IDF words of every template, postings (template, position). Where such a word stands in a
file, its postings give the template's start; starts that the file's licence words agree on are
verified word by word, within a small shift, and the key phrases must stand whole where the template
has them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: The phrases of the base labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates (label, words, mandatory key phrases), from the licences' own titles, notices and bodies.
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "apache license version 2 0 january 2004", ("apache license version 2",)),
    ("apache-2", "apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "the following conditions are met")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsd", "bsd 3 clause license", ("bsd 3 clause license",)),
    ("bsd", "bsd 2 clause license", ("bsd 2 clause license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by", "creative commons attribution 4 0 international", ("creative commons attribution 4 0 international",)),
    ("cc-by", "creative commons attribution 4 0 international public license", ("creative commons attribution 4",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international public license", ("attribution noncommercial",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc0", "creative commons legal code cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "gnu general public license version 2 june 1991", ("gnu general public license version 2",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by", "either version 2 of the license",)),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it", ("most software are designed to take away your freedom",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ("gnu general public license version 3",)),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by", "either version 3 of the license",)),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", ("free copyleft license for software and other kinds of works",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", ("the author disclaims all warranties with regard to this software",)),
    ("isc", "isc license copyright", ("isc license",)),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("lgpl-3", "gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", ("lesser general public license version 3",)),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu lesser general public license as published by", "either version 3 of the license",)),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", ("version of the gnu lesser general public license incorporates",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "the mit license mit", ("the mit license mit",)),
    ("mit", "mit license copyright c", ("mit license copyright",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("all copies or substantial portions of the software",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl was not distributed with this file",)),
)
#: Share that must stand in place of a template's words, or of those in the index, its rarest. The
#: index holds so many that no such match lacks all of them. A place may be off by SHIFT words.
SHARE, SHIFT = 0.75, 3

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[0x00:0x30] = SEPARATOR[0x3A:0x61] = SEPARATOR[0x7B:0x80] = True


def _hash(text: str) -> np.ndarray:
    data, offsets = tb.laid_out(pa.array([text]))
    starts, ends, _ = tb.words(data, offsets, SEPARATOR)
    return tb.Rolling(data).of(starts, ends)


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def _file_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.laid_out(column)
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets, SEPARATOR)
    return tb.Rolling(data).of(starts, ends), first


def _frequencies(batches):
    """Rows (word, texts that hold it) of the vocabulary, and ("", texts)."""
    vocabulary = np.array([_hash(w)[0] for w in VOCABULARY])
    order = np.argsort(vocabulary)
    counts, texts = np.zeros(len(vocabulary), dtype=np.int64), 0
    for whole in batches:
        for b in tb.pieces(whole):
            words, first = _file_words(b.column("text"))
            texts += b.num_rows
            at = np.minimum(np.searchsorted(vocabulary[order], words), len(order) - 1)
            hit = np.flatnonzero(vocabulary[order][at] == words)
            doc = np.searchsorted(first, hit, "right") - 1
            pairs = np.unique(doc * len(order) + at[hit])
            counts += np.bincount(order[pairs % len(order)], minlength=len(order))
    yield pa.record_batch([pa.array([*VOCABULARY, ""]), pa.array([*counts.tolist(), texts])], names=["word", "n"])


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """IDF of every vocabulary word over all of docs; as many rows as words come to the driver."""
    rows = docs.mapInArrow(_frequencies, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: float(np.log((n.get("", 0) + 1) / (n.get(w, 0) + 1))) for w in VOCABULARY}


def _place(words: list[str], key: list[str]) -> int:
    """Where key stands in words."""
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


class Index:
    """Postings of the rarest words, templates and key phrases as word hashes."""

    def __init__(self, idf: dict[str, float]):
        self.templates = [(label, _hash(text), [_hash(k) for k in keys]) for label, text, keys in TEMPLATES]
        self.keys = [[_place(text.split(), key.split()) for key in keys] for _, text, keys in TEMPLATES]
        self.rarest: list[list[int]] = []
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for i, (_, text, _) in enumerate(TEMPLATES):
            own = text.split()
            places = 0
            self.rarest.append([])
            for w in sorted(set(own), key=lambda w: (-idf.get(w, 0.0), w)):
                if places > (1 - SHARE) * len(own):  # any match that is good enough has one of these
                    break
                for place, other in enumerate(own):
                    if other == w:
                        self.postings.setdefault(int(_hash(w)[0]), []).append((i, place))
                        self.rarest[i].append(place)
                        places += 1
        self.rare = np.array(sorted(self.postings), dtype=np.uint64)
        self.base = [(_hash(text), label) for text, label in BASE.items()]

    def scan(self, words: np.ndarray, first: np.ndarray):
        """Places (text, word, label, score) of templates, and (text, word, label) of base phrases."""
        found, base = [], []
        if not len(words):
            return found, base
        at = np.minimum(np.searchsorted(self.rare, words), len(self.rare) - 1)
        hit = np.flatnonzero(self.rare[at] == words)
        doc = np.searchsorted(first, hit, "right") - 1
        starts: dict[int, list[np.ndarray]] = {}
        for k in np.unique(at[hit]):
            here = at[hit] == k
            for template, place in self.postings[int(self.rare[k])]:
                starts.setdefault(template, []).append(np.stack([doc[here], hit[here] - place]))
        for template, parts in starts.items():
            label, text, keys = self.templates[template]
            rows = np.unique(np.concatenate(parts, axis=1), axis=1)
            # A template may begin before the file or end after it; what lies outside doesn't match.
            d, s = rows
            near = np.zeros((2 * SHIFT + 1, len(s), len(text)), dtype=bool)
            for by in range(-SHIFT, SHIFT + 1):
                for q, w in enumerate(text):
                    at = s + q + by
                    near[by + SHIFT, :, q] = (at >= first[d]) & (at < first[d + 1]) & (words[np.clip(at, 0, len(words) - 1)] == w)
            equal = near.any(0)
            score = equal.mean(1)
            good = (score >= SHARE) | (equal[:, self.rarest[template]].mean(1) >= SHARE)
            for key, place in zip(keys, self.keys[template], strict=True):
                good &= near[:, :, place : place + len(key)].all(2).any(0)
            # Starts that differ by a shift are one place: the one with the most words exactly there.
            exact = near[SHIFT].sum(1)
            run = np.cumsum(np.append(True, (np.diff(d[good]) != 0) | (np.diff(s[good]) > min(SHIFT, len(text) - 1))))[: good.sum()]
            kept = np.flatnonzero(good)[np.lexsort((s[good], -exact[good], run))]
            good = kept[np.unique(np.sort(run), return_index=True)[1]]
            found += [(int(x), int(max(y - first[x], 0)), label, float(z)) for x, y, z in zip(d[good], s[good], score[good], strict=True)]
        for text, label in self.base:
            s = np.flatnonzero(words[: len(words) - len(text) + 1] == text[0])
            for q in range(1, len(text)):
                s = s[words[s + q] == text[q]]
            d = np.searchsorted(first, s, "right") - 1
            ok = s + len(text) <= first[d + 1]
            base += [(int(x), int(y - first[x]), label) for x, y in zip(d[ok], s[ok], strict=True)]
        return found, base


OUT = "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string,score:double,base:boolean>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and places (word, label, score, base), in order, for every row of docs: where
    base phrases and templates stand. IDF comes from all of docs. Null texts are empty, without
    words and places; a phrase never runs from one text into the next; extra columns are ignored."""
    docs = common.documents(docs, id_col, text_col)
    index = docs.sparkSession.sparkContext.broadcast(Index(inverse_frequencies(docs.select("text"))))

    def run(batches):
        for whole in batches:
            for b in tb.pieces(whole):
                words, first = _file_words(b.column("text"))
                found, base = index.value.scan(words, first)
                rows: list[list] = [[] for _ in range(b.num_rows)]
                for d, w, label, score in found:
                    rows[d].append((w, label, score, False))
                for d, w, label in base:
                    rows[d].append((w, label, 1.0, True))
                names = ("word", "label", "score", "base")
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(np.diff(first)), pa.array([[dict(zip(names, x, strict=True)) for x in sorted(r)] for r in rows], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])))],
                    names=["doc_id", "n_words", "places"],
                )

    return docs.mapInArrow(run, OUT)
