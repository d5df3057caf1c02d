"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over W bytes marks triggers, which depend on nothing but those bytes; the stretch
from a trigger to the end of the next is a phrase. A window of `length` bytes can only start
elsewhere too if every phrase wholly inside it occurs at least twice in the corpus, so one count
of phrases (the dictionary's frequencies) leaves the repetitive part of the corpus.

There, every window is a suffix of the phrase that ends at the window's first trigger, followed by
a prefix of the parse from that trigger on. Dictionary and parse are put in order by sorted
suffixes: phrases by their bytes read backwards, so that phrases with a common suffix are
neighbours, and parse suffixes by their bytes; with the lengths that neighbours share, both orders
together give each window's class in corpus order. Windows are equal exactly when they fall in one
run of either order. Both are made per block of windows that agree in the bytes next to the trigger, so only the rest is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Bytes of a trigger, and one position in how many is a trigger.
W, ONE_IN = 16, 64
#: Distances before a trigger that one row covers: such windows share all but this many bytes.
STEP = 64
#: Windows of a block that one sort takes; blocks end between keys.
BLOCK = 40_000
#: Bytes of text that are looked at together; repeats among them are settled before anything is sent.
PIECE = 1 << 21


def _triggers(roll: tb.Rolling, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all triggers and the text of each."""
    n = len(roll.sums) - 1 - W
    if n < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tb.mix((roll.sums[W:] - roll.sums[: n + 1]) * roll.back[: n + 1])
    t = np.flatnonzero(h < np.uint64(2**64 // ONE_IN))
    doc = np.searchsorted(offsets, t, "right") - 1
    inside = t + W <= offsets[doc + 1]
    return t[inside], doc[inside]


def _lowest(roll: tb.Rolling, reach: int) -> np.ndarray:
    """For each position the first of the lowest trigger hashes from it to `reach` further on: where
    no trigger is near, this takes its place, and like it depends on the window's bytes alone."""
    n = max(len(roll.sums) - W, 1)
    h = np.zeros(n, dtype=np.uint64)
    h[: len(roll.sums) - W] = tb.mix((roll.sums[W:] - roll.sums[: len(roll.sums) - W]) * roll.back[: len(roll.sums) - W])
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= reach + 1:
        low[: n - span] = np.minimum(low[: n - span], low[span:])
        span *= 2
    rest = reach + 1 - span
    if rest and n > rest:
        low[: n - rest] = np.minimum(low[: n - rest], low[rest:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _phrases(roll, t, doc):
    """Starts, ends and hashes of phrases, and the text of each."""
    same = np.flatnonzero(doc[1:] == doc[:-1])
    start, end = t[same], t[same + 1] + W
    return start, end, roll.of(start, end), doc[same]


def _parse(length: int):
    def run(batches):
        for whole in batches:
            for b in tb.pieces(whole, most=PIECE):
                data, offsets = tb.laid_out(b.column("text"))
                roll = tb.Rolling(data)
                t, doc = _triggers(roll, offsets)
                start, end, h, owner = _phrases(roll, t, doc)
                long = np.diff(offsets) >= length
                use = long[owner]
                start, h, owner = start[use], h[use], owner[use]
                _, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                times = times[which]
                # Repeats inside this piece are settled here: one row of them asks and answers for the
                # others, which travel under keys of their own, so no key gathers more rows than pieces.
                rest = np.ones(len(h), dtype=bool)
                rest[first] = False
                h = np.where(rest, tb.mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), h)
                # Texts with a window that holds no whole phrase are looked at in any case.
                open_ = np.zeros(len(long), dtype=bool)
                edge = [np.concatenate([offsets[:-1], t]), np.concatenate([np.arange(len(long)), doc])]
                order = np.lexsort(edge)
                at, of = edge[0][order], edge[1][order]
                # From a trigger (or the start), two triggers on, or the end, must lie within the length.
                ahead = np.minimum(np.arange(len(at)) + 2, len(at) - 1)
                near = (of[ahead] == of) & (np.arange(len(at)) + 2 < len(at))
                wide = (np.where(near, at[ahead] + W, offsets[of + 1] + 1) - at > length) & long[of]
                open_[of[wide]] = True
                mark = np.flatnonzero(open_)
                ids, th = b.column("doc_id"), b.column("th")
                rows = pa.array(np.concatenate([owner, mark]))
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([h, tb.mix(mark.astype(np.uint64) * np.uint64(977) + h.sum(dtype=np.uint64))]).view(np.int64)),
                        ids.take(rows),
                        th.take(rows),
                        pa.array(np.concatenate([start - offsets[owner], np.full(len(mark), -1)]).astype(np.int32)),
                        pa.array(np.concatenate([times, np.full(len(mark), 2)]).astype(np.int32)),
                    ],
                    names=["phrase", "doc_id", "th", "start", "times"],
                )

    return run


def _spans_of(docs, s, e):
    """Overlapping or touching [s, e) of each text merged; input sorted by text and start."""
    if not len(s):
        return docs, s, e
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (s[1:] > e[:-1])
    begin = np.flatnonzero(fresh)
    return docs[begin], s[begin], np.maximum.reduceat(e, begin)


CONTEXT = "slot bigint, test bigint, doc_id bigint, th bigint, at int, lo int, hi int, left binary, right binary, s int, e int"


def _stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    sizes = end - start
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    index = np.arange(offs[-1]) + np.repeat(start - offs[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(data[index].tobytes())])


def _contexts(length: int):
    """For texts with the starts of their repeated phrases: repeats settled within the piece as spans,
    and for each distinct context of candidate windows a row with its left and right bytes."""
    cap = length // 2

    def run(batches):
        for whole in batches:
            for b in tb.pieces(whole, most=PIECE):
                data, offsets = tb.laid_out(b.column("text"))
                n = len(data)
                rolls = [tb.Rolling(data, k) for k in (0, 1)]
                t, doc = _triggers(rolls[0], offsets)
                start, end, _, owner = _phrases(rolls[0], t, doc)
                known = b.column("starts")
                have = known.values.to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(known.offsets.to_numpy())
                have = have[known.offsets[0].as_py() : known.offsets[-1].as_py()]
                have = np.where(have < 0, -1, have + np.repeat(offsets[:-1], sizes))
                bad = ~np.isin(start, have)
                # Windows that hold a phrase of a single occurrence are out, and those past a text's end.
                flux = np.zeros(n + 2, dtype=np.int32)
                lo, hi = np.maximum(end[bad] - length, offsets[owner[bad]]), start[bad]
                ok = lo <= hi
                np.add.at(flux, lo[ok], 1)
                np.add.at(flux, hi[ok] + 1, -1)
                tail = np.maximum(offsets[1:] - length + 1, offsets[:-1])
                np.add.at(flux, tail, 1)
                np.add.at(flux, offsets[1:], -1)
                p = np.flatnonzero(np.cumsum(flux)[:n] == 0)
                if not len(p):
                    continue
                own = np.searchsorted(offsets, p, "right") - 1
                k = np.searchsorted(t, p)
                anchor = np.where(k < len(t), t[np.minimum(k, max(len(t) - 1, 0))] if len(t) else n + length, n + length)
                far = anchor - p > cap
                if far.any():
                    anchor[far] = _lowest(rolls[0], cap)[p[far]]
                # Candidates of one anchor lie side by side: [lo, hi] bytes before it.
                fresh = np.ones(len(p), dtype=bool)
                fresh[1:] = anchor[1:] != anchor[:-1]
                begin = np.flatnonzero(fresh)
                last = np.append(begin[1:], len(p)) - 1
                at, own = anchor[begin], own[begin]
                hi, lo = at - p[begin], at - p[last]
                stop = at + length - lo
                h = [r.of(at - hi, stop) ^ tb.mix((lo * 65536 + hi).astype(np.uint64)) for r in rolls]
                order = np.lexsort(h)
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
                group = np.cumsum(new) - 1
                times = np.bincount(group)[group]
                several = np.zeros(len(order), dtype=bool)
                several[order] = times > 1
                ask = np.sort(order[new])
                d, s, e = _spans_of(own[several], (at - hi)[several], stop[several])
                ids, th = b.column("doc_id"), b.column("th")
                # Windows that begin `level` to `level` + STEP - 1 bytes before the anchor have the bytes
                # from `level` before it in common; what differs is up to STEP - 1 bytes on either side.
                core = length - STEP + 1
                rows = [(ask[(lo[ask] < level + STEP) & (hi[ask] >= level)], level) for level in range(0, cap + 1, STEP)]
                level = np.concatenate([np.full(len(r), k) for r, k in rows])
                ask = np.concatenate([r for r, _ in rows])
                near, off = np.maximum(lo[ask], level) - level, np.minimum(hi[ask], level + STEP - 1) - level
                mid = at[ask] - level
                slot, test = (tb.mix(r.of(mid, mid + core) + level.astype(np.uint64)) for r in rolls)
                none = pa.nulls(len(s), pa.int32())
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([slot, tb.mix(np.arange(len(s), dtype=np.uint64) + h[0].sum(dtype=np.uint64))]).view(np.int64)),
                        pa.array(np.concatenate([test, np.zeros(len(s), dtype=np.uint64)]).view(np.int64)),
                        ids.take(pa.array(np.concatenate([own[ask], d]))),
                        th.take(pa.array(np.concatenate([own[ask], d]))),
                        pa.concat_arrays([i32(mid - offsets[own[ask]]), none]),
                        pa.concat_arrays([i32(near), none]),
                        pa.concat_arrays([i32(off), none]),
                        pa.concat_arrays([_stretches(data, mid - off, mid), pa.nulls(len(s), pa.binary())]),
                        pa.concat_arrays([_stretches(data, mid + core, mid + length - near), pa.nulls(len(s), pa.binary())]),
                        pa.concat_arrays([pa.nulls(len(ask), pa.int32()), i32(s - offsets[d])]),
                        pa.concat_arrays([pa.nulls(len(ask), pa.int32()), i32(e - offsets[d])]),
                    ],
                    names=[x.split()[0] for x in CONTEXT.split(", ")],
                )

    return run


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes padded with zeros, each followed by its length, most significant byte first."""
    data, offsets = tb.laid_out(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width + 4), dtype=np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data)) - offsets[row]
    out[row, sizes[row] - 1 - place if backwards else place] = data
    out[:, width:] = sizes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out, sizes


def _order(m: np.ndarray, sizes: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows within their slots, and the bytes each shares with the one before it (-1 at a new slot)."""
    order = np.argsort(np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(slot[order], kind="stable")]
    shared = np.full(len(order), -1, dtype=np.int64)
    for i in range(1, len(order), 4096):  # bounded blocks
        y = order[i : i + 4096]
        x = order[i - 1 : i - 1 + len(y)]
        differ = m[x, :width] != m[y, :width]
        first = np.where(differ.any(1), differ.argmax(1), width)
        shared[i : i + len(y)] = np.where(slot[x] == slot[y], np.minimum(first, np.minimum(sizes[x], sizes[y])), -1)
    return order, shared


def _repeated(slot, test, lo, hi, left, right):
    """For each row the smallest and largest distance (from 0 to STEP - 1, on top of its level) at which the window has an equal; -1 if none."""
    n, width = len(slot), STEP - 1
    block = np.unique(np.stack([slot, test]), axis=1, return_inverse=True)[1].ravel()
    m, sizes = _matrix(left, width, True)
    by_left, shared_left = _order(m, sizes, block, width)
    m, sizes = _matrix(right, width, False)
    by_right, shared_right = _order(m, sizes, block, width)
    del m
    least, most = np.full(n, -1), np.full(n, -1)
    name_left, name_right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for back in range(int(hi.max()) + 1 if n else 0):
        use = np.flatnonzero((lo <= back) & (back <= hi))
        if len(use) < 2:
            continue
        name_left[by_left] = np.cumsum(shared_left < back)
        name_right[by_right] = np.cumsum(shared_right < width - back)
        name = name_left[use] * (n + 1) + name_right[use]
        order = np.argsort(name)
        same = name[order][1:] == name[order][:-1]
        hit = np.zeros(len(use), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = use[hit]
        least[at] = np.where(least[at] < 0, back, least[at])
        most[at] = back
    return least, most


def _combine(length: int):
    """Rows sorted by slot to spans of repeated windows."""

    def spans(table: pa.Table):
        table = table.combine_chunks()
        out = []
        settled = table.filter(table["left"].is_null())
        if settled.num_rows:
            out.append(settled.select(["doc_id", "th", "s", "e"]))
        table = table.filter(table["left"].is_valid())
        if table.num_rows:
            col = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
            at = col("at")
            least, most = _repeated(col("slot"), col("test"), col("lo"), col("hi"), table["left"], table["right"])
            hit = np.flatnonzero(least >= 0)
            take = pa.array(hit)
            out.append(pa.table([table["doc_id"].take(take), table["th"].take(take), pa.array((at - most)[hit].astype(np.int32)), pa.array((at - least + length)[hit].astype(np.int32))], names=["doc_id", "th", "s", "e"]))
        for x in out:
            yield from x.combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                table = pa.Table.from_batches(held)
                slots = table["slot"].to_numpy()
                cut = int(np.searchsorted(slots, slots[-1]))  # the last slot may go on
                if cut:
                    yield from spans(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = table.num_rows - cut
        if held:
            yield from spans(pa.Table.from_batches(held))

    return run


CUT = "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"


def _cut(batches):
    for whole in batches:
        for b in tb.pieces(whole, most=PIECE):
            ids, texts, spans = b.column("doc_id"), b.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), b.column("spans").to_pylist()
            merged, kept = [], []
            for text, found in zip(texts, spans, strict=True):
                out, runs, past = [], [], 0
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if runs and s <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], e)
                    else:
                        runs.append({"start": s, "end": e})
                for r in runs:
                    out.append(text[past : r["start"]])
                    past = r["end"]
                out.append(text[past:])
                merged.append(runs)
                kept.append(b"".join(out))
            yield pa.record_batch(
                [ids, pa.array([len(x) for x in texts], pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, [start, end) in bytes) and kept (the bytes left)
    for every row of docs: each byte is removed that a string of `length` bytes covers which also
    starts anywhere else, in the same text or another. Matches don't cross texts.

    Null texts are empty; texts shorter than `length` lose nothing. A repeated row is another text,
    so both lose all. Null doc_ids are allowed. Extra columns are ignored. Every text must fit a
    worker's memory about forty times over.
    """
    if length < 4 * W:
        raise ValueError(f"length must be at least {4 * W}")
    base = common.documents(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    key = Window.partitionBy("phrase")
    repeated = (
        base.where(F.octet_length("text") >= length)
        .mapInArrow(_parse(length), "phrase bigint, doc_id bigint, th bigint, start int, times int")
        .withColumn("all", F.sum("times").over(key))
        .where("all > 1")
        .groupBy("doc_id", "th")
        .agg(F.collect_list("start").alias("starts"))
    )
    both = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    looked = base.join(repeated, both(base, repeated)).select(base["doc_id"], base["th"], "text", "starts")
    rows = looked.mapInArrow(_contexts(length), CONTEXT).repartition("slot").sortWithinPartitions("slot")
    spans = (
        rows.mapInArrow(_combine(length), "doc_id bigint, th bigint, s int, e int")
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    )
    return base.join(spans, both(base, spans), "left").select(base["doc_id"], "text", "spans").mapInArrow(_cut, CUT)
