"""Token sequences of fixed length, packed by shortest-pack-first over the histogram of lengths.

Documents longer than a sequence are cut into full sequences and a rest. The rests' histogram, of
at most `size` bins, is all that the packing reads: lengths are placed longest first, each into the
open pattern with the least room left that was filled least, whole counts at a time. Every
(pattern, place) then serves a range of ranks among the pieces of its length, and pieces find
theirs by rank.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Texts between spaces whose tokens a worker remembers at most.
REMEMBERED = 100_000
#: Parts in which the pieces of one length are ranked.
PARTS = 1024


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A byte-level vocabulary file of the tokenizers library, encoded through tiktoken's faster core.

    A space before a character that is no white space always begins a token, so the text between two
    such spaces is encoded on its own, once for many. The file's added tokens are split off before, as in that
    library; with encode_special_tokens the special ones among them are ordinary text."""

    def __init__(self, path: str, encode_special_tokens: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _bytes_of_symbols()
        merged = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]}
        made = {"".join(m) for m in merged}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if len(token) == 1 or token in made}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or () if not (encode_special_tokens and t["special"])}
        if any(t[k] for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or need white space are not supported")
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.uneven = re.compile(r" (?:\s|$)").search
        self.seen: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split is None or not (marks := list(self.split.finditer(text))):
            return self._ordinary(text)
        out, begin = [], 0
        for m in marks:
            out += [self._ordinary(text[begin : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            begin = m.end()
        return b"".join([*out, self._ordinary(text[begin:])])

    def _ordinary(self, text: str) -> bytes:
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        if self.uneven(text):
            return self._encode(text)
        parts, seen = text.split(" "), self.seen
        out = [self._piece(parts[0], "")]
        for x in parts[1:]:
            got = seen.get(x)
            out.append(self._piece(x, " ") if got is None else got)
        return b"".join(out)

    def _piece(self, part: str, lead: str) -> bytes:
        ids = self._encode(lead + part)
        if lead:
            self.seen[part] = ids
        return ids


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit) of the pieces
    of every row of docs, each followed by end_id: full sequences, then the rest. Null is empty.
    encode_special_tokens is the tokenizers library's setting of that name, which is False there."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        tokens = Tokens(path, encode_special_tokens)
        for whole in batches:
            for b in tb.pieces(whole, most=1 << 20):
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = tokens(text or "") + tail
                    n = len(ids) // 4
                    view = memoryview(ids)
                    for i in range(0, n, size):
                        own = view[4 * i : 4 * min(i + size, n)]
                        rows.append((doc_id, i, len(own) // 4, zlib.crc32(own), n, bytes(own) if with_ids else None))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(cols)], names=[x.split()[0] for x in PIECE.split(", ")])

    return common.documents(docs, id_col, text_col).mapInArrow(run, PIECE)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences have each. Lengths go longest first into the
    patterns with the most room left (the shortest packs) that still hold them; a pattern is split
    when fewer pieces than sequences are left. Room is looked up by its size, so the work depends on
    the number of lengths, not of pieces."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    best = 0  # no pattern has more room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while best and not room[best]:
                best -= 1
            fits = _exact(room, length, best)
            if not fits:
                room[size - length].append(((length,), left))
                best = max(best, size - length)
                break
            pattern, count = room[fits].pop()
            used = min(left, count)
            if used < count:
                room[fits].append((pattern, count - used))
            room[fits - length].append(((*pattern, length), used))
            left -= used
    return [x for patterns in room for x in patterns]


def _exact(room, length: int, best: int) -> int:
    """The room of the shortest pack that holds length, or length itself if a pack is filled by it; 0 if none."""
    if length < len(room) and room[length]:
        return length
    return best if best >= length else 0


def packed(found: DataFrame, size: int = 2048) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. Full pieces are sequences by themselves; the
    histogram of the others, of fewer than `size` rows, comes to the driver, and the patterns go out,
    of which there are no more than a few per length."""
    spark = found.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    found = found.withColumn("part", part)
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0  # (length, first rank, pieces of a sequence here, first sequence, offsets)
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    for pattern, count in sorted(shortest_pack_first(histogram, size), reverse=True):
        offset, i = 0, 0
        while i < len(pattern):
            length = pattern[i]
            times = pattern.count(length)
            slots.append((length, taken[length], taken[length] + times * count, times, sequence, offset))
            taken[length] += times * count
            offset += times * length
            i += times
        sequence += count
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))  # PARTS rows a length at most
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = found.withColumn("rank", F.row_number().over(within)).join(F.broadcast(firsts.select("length", "part", "first")), ["length", "part"])
    names = [c for c in found.columns if c != "part"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "part") + ", sequence_id bigint, offset bigint"

    def place(batches):
        t = shared.value
        key = t[:, 0] << 44 | t[:, 1] if len(t) else np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = t[np.searchsorted(key, length << 44 | rank, "right") - 1]
            i = rank - row[:, 1]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(row[:, 4] + i // row[:, 3]), pa.array(row[:, 5] + i % row[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("first") + F.col("rank") - 1).alias("rank")).mapInArrow(place, schema)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = True) -> DataFrame:
    """pieces() of every row of docs, packed(). doc_ids may be null or repeated; each row is a document
    of its own. Equal pieces (of the same doc_id, start and ids) may change places. No rows give no
    sequences. The ids themselves are left out here; pieces() has them."""
    return packed(common.stored(pieces(docs, path, size, end_id, False, id_col, text_col, encode_special_tokens).drop("ids"), "pieces"), size)
