"""Texts scored by a log-bilinear language model over word classes, and by a smoothed unigram.

Words fall into CLASSES classes: the most frequent ones, and the end, have one each; others share
one by their last two bytes. The model gives each class's probability after the two before it, and
that of a word within its class from its count and its own vector, so every token has a normalised
probability, known or not. Both parts are trained by noise-contrastive estimation on the counts of
all training texts: the classes' on the driver, over all class triples at every step, and the words'
in partitions by word, each over all contexts that its word has. Contexts are known by their classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Classes, of which TOP belong to one word each, one to the end and the others to word endings.
CLASSES, TOP = 128, 63
END_CLASS, ENDINGS = TOP, CLASSES - TOP - 1
#: Words whose counts every executor holds, at most; the others' counts are joined.
HELD = 1 << 17
#: Width of the vectors, noise and steps over all triples in training.
WIDTH, NOISE, STEPS = 24, 8, 500
#: Of a word's own vector: noise draws for each of its contexts, turns over them, weight of its prior,
#: and steps a unit in which it is kept. FITTED rows are taken at a time; of these AT_ONCE, which a
#: processor's cache holds, go through all turns together, as words of equally many contexts.
WORD_NOISE, TURNS, PRIOR, STEP, FITTED, AT_ONCE = 4, 6, 8.0, 64, 200_000, 2048
#: Distinct words that a worker gathers before it passes their counts on.
GATHERED = 1 << 20
END = np.uint64(0xE4D0E4D0E4D0E4D0)
#: End of a model's score for a class without words.
TINY = 1e-300


def _tokens(column: pa.Array):
    """Hash and ending of each word, and for each text the index of its first word."""
    data, offsets = tb.laid_out(column)
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets)
    last = data[ends - 1].astype(np.uint32) if len(ends) else np.zeros(0, np.uint32)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32) if len(ends) else last
    ending = ((before * np.uint32(256) + last) * np.uint32(2654435769) >> np.uint32(16)) % np.uint32(ENDINGS)
    return tb.Rolling(data).of(starts, ends), ending.astype(np.int64), first


def _counted(batches):
    """Partial counts (word, ending, n) of words and ends."""

    def summed(parts):
        word = np.concatenate([p[0] for p in parts])
        unique, at, which = np.unique(word, return_index=True, return_inverse=True)
        n = np.zeros(len(unique), dtype=np.int64)
        np.add.at(n, which, np.concatenate([p[2] for p in parts]))
        return unique, np.concatenate([p[1] for p in parts])[at], n

    def batch(part):
        return pa.record_batch([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], names=["word", "ending", "n"])

    parts, held = [], 0
    for whole in batches:
        for b in tb.pieces(whole):
            h, ending, _ = _tokens(b.column("text"))
            word, at, n = np.unique(h, return_index=True, return_counts=True)
            parts += [(word, ending[at], n), (np.array([END]), np.array([-1]), np.array([b.num_rows]))]
            held += len(word)
            if held > 2 * GATHERED:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held > GATHERED:
                    yield batch(parts[0])
                    parts, held = [], 0
    if parts:
        yield batch(summed(parts))


def _classes(h: np.ndarray, ending: np.ndarray, top: np.ndarray, top_class: np.ndarray) -> np.ndarray:
    out = TOP + 1 + ending
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        hit = top[at] == h
        out[hit] = top_class[at[hit]]
    return out


def _sequences(classes: np.ndarray, first: np.ndarray):
    """Class sequences with each text's end, as triples of class codes, and the text of each token."""
    counts = np.diff(first)
    n_docs = len(counts)
    places = np.arange(len(classes)) + np.repeat(np.arange(n_docs), counts)
    out = np.full(len(classes) + n_docs, END_CLASS, dtype=np.int64)
    out[places] = classes
    begin = first[:-1] + np.arange(n_docs)
    one = np.empty_like(out)
    one[1:], one[:1] = out[:-1], END_CLASS
    one[begin] = END_CLASS
    two = np.empty_like(out)
    two[1:], two[:1] = one[:-1], END_CLASS
    two[begin] = END_CLASS
    return (two * CLASSES + one) * CLASSES + out, np.repeat(np.arange(n_docs), counts + 1), places


def _triples(top, top_class):
    def run(batches):
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for whole in batches:
            for b in tb.pieces(whole):
                h, ending, first = _tokens(b.column("text"))
                code, _, _ = _sequences(_classes(h, ending, top, top_class), first)
                total += np.bincount(code, minlength=CLASSES**3)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    return run


def _learned(triples: np.ndarray, counts: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | two classes before), CLASSES**2 x CLASSES, and the vectors of contexts by place
    and class, of a log-bilinear model trained by noise-contrastive estimation. Every step takes all
    counts and the noise's expectation: nothing is drawn."""
    rng = np.random.default_rng(seed)
    reach = CLASSES
    seen = np.zeros(reach**3, dtype=np.float32)
    seen[triples] = counts / max(counts.sum(), 1)
    seen = seen.reshape(-1, reach)
    unigram = seen.sum(0, dtype=np.float64) + 0.5 / max(counts.sum(), 1)
    unigram /= unigram.sum()
    given = rng.normal(0, 0.1, (2, reach, WIDTH)).astype(np.float32)  # vectors of context classes, by place
    mixed = np.ones((2, WIDTH), dtype=np.float32)  # diagonal context matrices
    target = rng.normal(0, 0.1, (reach, WIDTH)).astype(np.float32)
    bias = np.log(unigram).astype(np.float32)
    params = [given, mixed, target, bias]
    past = [np.full_like(p, 1e-8) for p in params]
    log_noise = (np.log(NOISE) + np.log(unigram)).astype(np.float32)
    both = seen + NOISE * seen.sum(1, keepdims=True) * unigram.astype(np.float32)
    for _ in range(STEPS if len(triples) else 0):
        context = ((given[0] * mixed[0])[:, None, :] + (given[1] * mixed[1])[None, :, :]).reshape(-1, WIDTH)
        error = context @ target.T
        error += bias - log_noise
        np.clip(error, -30, 30, out=error)
        np.exp(-error, out=error)
        error += 1
        np.divide(both, error, out=error)
        error -= seen
        to_context = (error @ target).reshape(reach, reach, WIDTH)
        to_place = [to_context.sum(1), to_context.sum(0)]
        grads = [
            np.stack([g * m for g, m in zip(to_place, mixed, strict=True)]),
            np.stack([(g * v).sum(0) for g, v in zip(to_place, given, strict=True)]),
            error.T @ context,
            error.sum(0),
        ]
        for p, g, s in zip(params, grads, past, strict=True):
            s += g * g
            p -= 0.1 * g / np.sqrt(s)
    context = (given[0] * mixed[0])[:, None, :] + (given[1] * mixed[1])[None, :, :]
    logits = context.reshape(-1, WIDTH) @ target.T + bias
    logits -= logits.max(1, keepdims=True)
    return ((logits - np.log(np.exp(logits).sum(1, keepdims=True))) / np.log(10)).astype(np.float32), given * mixed[:, None, :]


def train(triples: np.ndarray, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """The table of _learned()."""
    return _learned(triples, counts, seed)[0]


def _places(given: np.ndarray, triples: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context vectors by place and class, moved and scaled so that their sums have mean 0 and
    deviation 1 over all tokens, with a last value that makes 1 of every sum."""
    out = np.zeros((2, CLASSES, WIDTH + 1))
    out[0, :, -1] = 1
    n = np.bincount(triples // CLASSES, weights=counts, minlength=CLASSES**2)
    if n.sum():
        sums = (given[0][:, None, :] + given[1][None, :, :]).reshape(-1, WIDTH).astype(np.float64)
        mean = n @ sums / n.sum()
        values, axes = np.linalg.eigh(((sums - mean).T * n) @ (sums - mean) / n.sum())
        white = axes / np.sqrt(np.maximum(values, 1e-3 * values.max() + 1e-12))
        out[0, :, :-1], out[1, :, :-1] = (given[0] - mean) @ white, given[1] @ white
    return out.astype(np.float32)


def _contexts(top, top_class):
    """Partial counts (word, triple, n). The word of a class of one needs no contexts."""

    def summed(parts):
        word, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((code, word))
        word, code, n = word[order], code[order], n[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
        begin = np.flatnonzero(new)
        return word[begin], code[begin], np.add.reduceat(n, begin) if len(begin) else n

    def batch(part):
        return pa.record_batch([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], names=["word", "triple", "n"])

    def run(batches):
        parts, held = [], 0
        for whole in batches:
            for b in tb.pieces(whole):
                h, ending, first = _tokens(b.column("text"))
                classes = _classes(h, ending, top, top_class)
                code, _, places = _sequences(classes, first)
                code = np.where(classes > END_CLASS, code[places], classes)
                parts.append(summed([(h, code, np.ones(len(h), dtype=np.int64))]))
                held += len(parts[-1][0])
                if held > 2 * GATHERED:
                    yield batch(summed(parts))
                    parts, held = [], 0
        if parts:
            yield batch(summed(parts))

    return run


def _vectors(shared):
    """(word, class, n, vector) of each word from its rows (word, triple, n), which come sorted by word."""

    def turned(each, weight):
        """The vectors of words of equally many contexts, each with its noise after it."""
        wide = np.abs(each)
        wide *= wide.sum(2, keepdims=True)  # bounds the curvature by its diagonal, so that no turn goes too far
        weight = np.repeat(weight, WORD_NOISE + 1, axis=1)
        true = np.arange(each.shape[1]) % (WORD_NOISE + 1) == 0
        t = np.zeros((len(each), WIDTH + 1), dtype=np.float32)
        for _ in range(TURNS):
            p = 1 / (1 + WORD_NOISE * np.exp(-np.clip(np.einsum("wkd,wd->wk", each, t), -20, 20)))
            slope = np.einsum("wk,wkd->wd", (p - true) * weight, each) + PRIOR * t
            t -= slope / (np.einsum("wk,wkd->wd", p * (1 - p) * weight, wide) + PRIOR)
        return t

    def fitted(rng, x, upto, word, code, n):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word))))
        kind = code[begin] % CLASSES
        tuned = np.flatnonzero(kind[of] > END_CLASS)
        v = np.zeros((len(begin), WIDTH + 1), dtype=np.float32)
        if len(tuned):
            own, start = np.unique(of[tuned], return_index=True)
            weight = n[tuned].astype(np.float32)
            k = kind[of[tuned]]
            low, high = upto[k * CLASSES**2], upto[(k + 1) * CLASSES**2]
            draws = low[:, None] + rng.random((len(k), WORD_NOISE)) * (high - low)[:, None]
            at = np.searchsorted(upto, draws, "right") - 1 - k[:, None] * CLASSES**2
            at = np.concatenate([code[tuned, None] // CLASSES, np.clip(at, 0, CLASSES**2 - 1)], axis=1)
            size = np.diff(np.append(start, len(tuned)))
            t = np.zeros((len(own), WIDTH + 1), dtype=np.float32)
            for m in np.unique(size):
                alike = np.flatnonzero(size == m)
                for i in range(0, len(alike), max(1, AT_ONCE // m)):
                    some = alike[i : i + max(1, AT_ONCE // m)]
                    rows = start[some, None] + np.arange(m)
                    t[some] = turned(x[at[rows]].reshape(len(some), -1, WIDTH + 1), weight[rows])
            v[own] = t
        held = np.clip(np.rint(v * STEP), -127, 127).astype(np.int8)
        vector = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(np.arange(len(held) + 1, dtype=np.int32) * (WIDTH + 1)), pa.py_buffer(held.tobytes())])
        return pa.record_batch([pa.array(word[begin]), pa.array(kind.astype(np.int32)), pa.array(np.add.reduceat(n, begin)), vector], names=["word", "class", "n", "vector"])

    def run(batches):
        x, upto = shared.value["x"], shared.value["upto"]
        rng = np.random.default_rng(1)
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(tuple(b.column(c).to_numpy() for c in ("word", "triple", "n")))
            held += b.num_rows
            if held > FITTED:
                word, code, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                last = int(np.searchsorted(word, word[-1]))  # this word may go on
                if last:
                    yield fitted(rng, x, upto, word[:last], code[:last], n[:last])
                parts, held = [(word[last:], code[last:], n[last:])], len(word) - last
        if parts:
            yield fitted(rng, x, upto, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    return run


def _values(column) -> np.ndarray:
    """The vectors of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, WIDTH + 1).astype(np.float32) / STEP


def _sums(shared):
    """(class, sums): of (n + 0.5) exp(context . vector) over a class's words, for every context. As a
    context is a sum of two vectors, they are products of two matrices."""

    def run(batches):
        places = shared.value["places"].astype(np.float64)
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            kind, v = b.column("class").to_numpy(), _values(b.column("vector")).astype(np.float64)
            one = np.exp(np.clip(places[0] @ v.T, -50, 50)) * (b.column("n").to_numpy() + 0.5)
            two = np.exp(np.clip(places[1] @ v.T, -50, 50))
            for k in np.unique(kind):
                sums[k] = sums.get(k, 0) + one[:, kind == k] @ two[:, kind == k].T
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([z.tobytes() for z in sums.values()], pa.binary())], names=["class", "sums"])

    return run


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, z in zip(b.column("class").to_pylist(), b.column("sums").to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(z)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([z.tobytes() for z in sums.values()], pa.binary())], names=["class", "sums"])


def _lifted(shared):
    """(key, log, known) of rows (key, word, context, times, n, vector), summed for each key of a batch."""

    def run(batches):
        x = shared.value["x"]
        for b in batches:
            if not b.num_rows:
                continue
            times, n = b.column("times").to_numpy(), b.column("n").fill_null(0).to_numpy()
            v = _values(b.column("vector").fill_null(bytes(WIDTH + 1)))
            base = times * np.log10(n + 0.5)
            lift = times * (x[b.column("context").to_numpy()] * v).sum(1, dtype=np.float64) / np.log(10)
            key, at = np.unique(b.column("key").to_numpy(), return_inverse=True)
            yield pa.record_batch([pa.array(key), *(pa.array(np.bincount(at, weights=w, minlength=len(key))) for w in (base, lift)), pa.array(np.bincount(at, weights=times * (n > 0), minlength=len(key)).astype(np.int64))], names=["key", "rare", "lift", "rare_known"])

    return run


OUT = "doc_id bigint, key bigint, word bigint, context int, times bigint, n_tokens bigint, n_known bigint, base double, model double"


def _scored(shared):
    def run(batches):
        m = shared.value
        top, top_class, held, held_log, held_vector, table, x = (m[k] for k in ("top", "top_class", "held", "held_log", "held_vector", "table", "x"))
        flat = table.ravel()
        for whole in batches:
            for b in tb.pieces(whole):
                h, ending, first = _tokens(b.column("text"))
                classes = _classes(h, ending, top, top_class)
                code, doc, places = _sequences(classes, first)
                n = b.num_rows
                model = np.bincount(doc, weights=flat[code], minlength=n)
                word_doc, context = doc[places], code[places] // CLASSES
                at = np.minimum(np.searchsorted(held, h), max(len(held) - 1, 0))
                hit = held[at] == h if len(held) else np.zeros(len(h), dtype=bool)
                base = np.bincount(word_doc[hit], weights=held_log[at[hit]], minlength=n) + m["end_log"]
                lift = np.einsum("td,td->t", x[context[hit]], held_vector[at[hit]].astype(np.float32)) / np.float32(STEP * np.log(10))
                model += np.bincount(word_doc[hit], weights=lift, minlength=n)
                known = np.bincount(word_doc[hit], minlength=n) + int(m["end_known"])
                rare, of, context = h[~hit], word_doc[~hit], context[~hit]
                order = np.lexsort((context, rare, of))
                rare, of, context = rare[order], of[order], context[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1]) | (context[1:] != context[:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(rare)))
                keys = b.column("key").to_numpy()
                none = lambda k, t: pa.nulls(k, t)
                yield pa.record_batch(
                    [
                        pa.concat_arrays([b.column("doc_id"), none(len(begin), pa.int64())]),
                        pa.array(np.concatenate([keys, keys[of[begin]]])),
                        pa.concat_arrays([none(n, pa.int64()), pa.array(rare[begin].view(np.int64))]),
                        pa.concat_arrays([none(n, pa.int32()), pa.array(context[begin].astype(np.int32))]),
                        pa.array(np.concatenate([np.ones(n, dtype=np.int64), times])),
                        pa.concat_arrays([pa.array(np.diff(first) + 1), none(len(begin), pa.int64())]),
                        pa.concat_arrays([pa.array(known.astype(np.int64)), none(len(begin), pa.int64())]),
                        pa.concat_arrays([pa.array(base), none(len(begin), pa.float64())]),
                        pa.concat_arrays([pa.array(model), none(len(begin), pa.float64())]),
                    ],
                    names=[x.split()[0] for x in OUT.split(", ")],
                )

    return run


def score(training: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    A token is a lower-cased word or the end, which every text has once. base_score sums the log10 of
    the unigram add-0.5 estimate over training's tokens; score is the model's log10 probability of the
    whole text. Null and empty texts are their end alone. Without training texts, every count is 0.
    Rows with the same doc_id and text share their lookups. Extra columns are ignored.

    To the driver come: class triples (CLASSES**3 at most), HELD words, and sums of CLASSES**3 cells.
    """
    spark = docs.sparkSession
    training = common.documents(training, id_col, text_col)
    docs = common.documents(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    counts = common.stored(
        training.select("text").mapInArrow(_counted, "word bigint, ending int, n bigint").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "counts"
    )
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).agg(F.count("*")).collect()}
    least, held = 0, 0
    for power in sorted(sizes, reverse=True):  # the most frequent words, as many as HELD allows
        if held + sizes[power] > HELD:
            least = 2 ** (power + 1)
            break
        held += sizes[power]
    end = np.int64(END.astype(np.int64))
    words = counts.where(F.col("word") != int(end))
    best = words.orderBy(F.desc("n"), "word").limit(TOP).select("word", "ending", "n").collect()
    ends = counts.where(F.col("word") == int(end)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = np.array([r["word"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(top)
    top, top_class = top[order], order.astype(np.int64)
    found = training.select("text").mapInArrow(_triples(top, top_class), "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).toPandas().sort_values("triple")
    triples, n = found["triple"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    table, given = _learned(triples, n)
    places = _places(given, triples, n)
    x = (places[0][:, None, :] + places[1][None, :, :]).reshape(-1, WIDTH + 1)
    by_class = np.zeros((CLASSES, CLASSES**2))
    by_class[triples % CLASSES, triples // CLASSES] = n
    fixed = spark.sparkContext.broadcast({"x": x, "places": places, "upto": np.append(0.0, np.cumsum(by_class))})
    vectors = common.stored(
        training.select("text")
        .mapInArrow(_contexts(top, top_class), "word bigint, triple int, n bigint")
        .repartition("word")
        .groupBy("word", "triple")
        .agg(F.sum("n").alias("n"))
        .sortWithinPartitions("word")
        .mapInArrow(_vectors(fixed), "word bigint, class int, n bigint, vector binary"),
        "vectors",
    )
    frequent = vectors.where(F.col("n") >= least).select("word", "n", "vector").toPandas()
    # Within a class: (c + 0.5) exp(context . vector) over the sum of the same, with 0.5 for all unknown words together.
    sums = np.full((CLASSES, CLASSES**2), 0.5)
    rows = vectors.where(F.col("class") > END_CLASS).mapInArrow(_sums(fixed), "class int, sums binary").repartition("class").mapInArrow(_added, "class int, sums binary").collect()
    for r in rows:
        sums[r["class"]] += np.frombuffer(r["sums"])
    for i, r in enumerate(best):  # a class of one word
        sums[i] += r["n"]
    end_log = float(np.log10(ends + 0.5))
    sums[END_CLASS] = ends + 0.5
    sums[len(best) : TOP] = 1.0
    table = (table - np.log10(sums).T).astype(np.float32)
    frequent_words = frequent["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(frequent_words)
    shared = spark.sparkContext.broadcast(
        {"top": top, "top_class": top_class, "held": frequent_words[by], "held_log": np.log10(frequent["n"].to_numpy(np.float64)[by] + 0.5), "held_vector": np.frombuffer(b"".join(bytes(z) for z in frequent["vector"]), dtype=np.int8).reshape(-1, WIDTH + 1)[by], "table": table, "x": x, "end_log": end_log, "end_known": ends > 0}
    )
    rows = common.stored(docs.mapInArrow(_scored(shared), OUT).withColumn("rare", F.col("word").isNotNull()), "scored", partition_by=["rare"])
    own = rows.where("not rare").select("doc_id", "key", "n_tokens", "n_known", "base", "model")
    rare = (
        rows.where("rare").select("key", "word", "context", "times")
        .join(vectors.select("word", "n", "vector"), "word", "left")
        .mapInArrow(_lifted(fixed), "key bigint, rare double, lift double, rare_known bigint")
        .groupBy("key")
        .agg(F.sum("rare").alias("rare"), F.sum("lift").alias("lift"), F.sum("rare_known").alias("rare_known"))
    )
    copies = own.groupBy("key").agg(F.count("*").alias("copies"))
    rare = rare.join(copies, "key").select("key", (F.col("rare") / F.col("copies")).alias("rare"), (F.col("lift") / F.col("copies")).alias("lift"), (F.col("rare_known") / F.col("copies")).cast("bigint").alias("rare_known"))
    per_token = float(np.log10(tokens + 0.5 * (distinct + 1)))
    zero = F.lit(0.0)
    return own.join(rare, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", zero) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + F.col("base") + F.coalesce("rare", zero) + F.coalesce("lift", zero)).alias("score"),
    )
