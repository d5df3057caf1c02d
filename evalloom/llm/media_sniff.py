"""Texts stored as small media files, and media recognised by their content.

store() lays a payload out as 8-bit samples of one of several formats. sniff() finds magic bytes
with one Aho-Corasick pass, lets each format's validator confirm structure and lengths, and returns
what stands there: the type of the file whatever was declared, and files embedded in it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Payloads fill whole units of UNIT bytes, pictures SIDE samples wide; FILL is what is appended.
UNIT, SIDE, FILL = 576, 24, b"\xff"


def _wav(p: bytes) -> bytes:
    pad = len(p) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(p) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p + b"\0" * pad


def _au(p: bytes) -> bytes:
    return b".snd" + struct.pack(">IIIII", 28, len(p), 2, 8000, 1) + b"\0" * 4 + p


def _pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(p) // SIDE) + p


def _bmp(p: bytes) -> bytes:
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return b"BM" + struct.pack("<IHHI", 1078 + len(p), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, SIDE, -(len(p) // SIDE), 1, 8, 0, len(p), 2835, 2835, 256, 256) + palette + p


def _png(p: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((len(p) // SIDE, SIDE + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(p, dtype=np.uint8).reshape(-1, SIDE)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def _read_wav(m: bytes, at: int):
    if len(m) < at + 12 or m[at + 8 : at + 12] != b"WAVE":
        return None
    end, place, known, samples = at + 8 + struct.unpack_from("<I", m, at + 4)[0], at + 12, False, None
    if end > len(m):
        return None
    while place + 8 <= end:  # chunks of any kind, in any order but the format before the data
        kind, n = m[place : place + 4], struct.unpack_from("<I", m, place + 4)[0]
        if place + 8 + n > end:
            return None
        if kind == b"fmt ":
            known = n >= 16 and all(struct.unpack_from("<HHI", m, place + 8))
        elif kind == b"data" and samples is None:
            if not known:
                return None
            samples = m[place + 8 : place + 8 + n]
        place += 8 + n + (n & 1)
    return None if samples is None else (end - at, samples)


def _read_au(m: bytes, at: int):
    if len(m) < at + 24:
        return None
    begin, n, encoding, rate, channels = struct.unpack_from(">IIIII", m, at + 4)
    if n == 0xFFFFFFFF and at + begin <= len(m):  # of unknown length: to the end
        n = len(m) - at - begin
    if begin < 24 or not (1 <= encoding <= 27) or not rate or not channels or at + begin + n > len(m):
        return None
    return begin + n, m[at + begin : at + begin + n]


PGM = re.compile(rb"P5" + 3 * rb"(?:\s|#[^\n\r]*[\n\r])+(\d{1,9})" + rb"\s")


def _read_pgm(m: bytes, at: int):
    if not (head := PGM.match(m, at)):
        return None
    width, height, most = map(int, head.groups())
    n = width * height * (2 if most > 255 else 1)
    return (head.end() - at + n, m[head.end() : head.end() + n]) if n and 0 < most < 65536 and head.end() + n <= len(m) else None


def _read_bmp(m: bytes, at: int):
    if len(m) < at + 26:
        return None
    size, _, _, begin = struct.unpack_from("<IHHI", m, at + 2)
    head = struct.unpack_from("<I", m, at + 14)[0]
    if head not in (12, 40, 52, 56, 64, 108, 124) or at + 14 + head > len(m) or begin < 14 + head or at + size > len(m) or begin > size:
        return None
    width, height, planes, bits = struct.unpack_from("<HHHH" if head == 12 else "<iiHH", m, at + 18)
    packing = struct.unpack_from("<I", m, at + 30)[0] if head > 12 else 0
    if planes != 1 or bits not in (1, 2, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    if packing in (1, 2):  # run lengths: not decoded
        return (size, b"") if begin < size else None
    stride, own = (width * bits + 31) // 32 * 4, (width * bits + 7) // 8
    if packing not in (0, 3, 6) or begin + stride * abs(height) > size:
        return None
    rows = m[at + begin : at + begin + stride * abs(height)]
    if height < 0 and stride == own:
        return size, rows
    lines = [rows[i : i + own] for i in range(0, len(rows), stride)]
    return size, b"".join(lines if height < 0 else reversed(lines))  # top line first


def _lines(data: bytes, stride: int, unit: int) -> bytes | None:
    """The samples of lines that begin with their filter's number; None if there is no such filter."""
    lines = np.frombuffer(data, dtype=np.uint8).reshape(-1, stride + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    if lines[:, 0].max() > 4:
        return None
    out, above = bytearray(), bytes(stride)
    for line in lines:
        kind, own = int(line[0]), bytearray(line[1:].tobytes())
        for i in range(stride if kind else 0):
            left, up, corner = own[i - unit] if i >= unit else 0, above[i], above[i - unit] if i >= unit else 0
            if kind == 4:
                guess = left + up - corner
                add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                add = (left, up, (left + up) // 2)[kind - 1]
            own[i] = (own[i] + add) & 255
        out += own
        above = own
    return bytes(out)


#: Bit depths and channels of PNG's colour types, and Adam7's passes (first column and line, steps).
COLOURS = {0: ((1, 2, 4, 8, 16), 1), 2: ((8, 16), 3), 3: ((1, 2, 4, 8), 1), 4: ((8, 16), 2), 6: ((8, 16), 4)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _read_png(m: bytes, at: int):
    place, body, shape = at + 8, [], None
    while place + 12 <= len(m):
        n = struct.unpack_from(">I", m, place)[0]
        if place + 12 + n > len(m):
            return None
        kind, chunk = m[place + 4 : place + 8], m[place + 8 : place + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack_from(">I", m, place + 8 + n)[0]:
            return None
        place += 12 + n
        if kind == b"IHDR" and n == 13:
            shape = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    else:
        return None
    if not shape:
        return None
    width, height, depth, colour, packing, filters, interlaced = shape
    if not width or not height or packing or filters or interlaced > 1 or depth not in COLOURS.get(colour, ((), 0))[0]:
        return None
    bits = depth * COLOURS[colour][1]
    passes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in ADAM7] if interlaced else [(width, height)]
    passes = [((w * bits + 7) // 8, h) for w, h in passes if w > 0 and h > 0]
    total = sum((w + 1) * h for w, h in passes)
    try:
        data = zlib.decompressobj().decompress(b"".join(body), total + 1)
    except zlib.error:
        return None
    if len(data) != total:
        return None
    out, begin = [], 0
    for w, h in passes:  # of an interlaced picture, its passes in order
        out.append(_lines(data[begin : begin + (w + 1) * h], w, max(1, bits // 8)))
        begin += (w + 1) * h
    return None if None in out else (place - at, b"".join(out))


def _read_gif(m: bytes, at: int):
    if len(m) < at + 13 or not all(struct.unpack_from("<HH", m, at + 6)):
        return None
    place, frames = at + 13 + (3 << (m[at + 10] & 7) + 1 if m[at + 10] & 128 else 0), 0
    while place < len(m):
        kind = m[place]
        if kind == 0x3B:
            return (place + 1 - at, b"") if frames else None
        if kind == 0x2C and place + 10 < len(m):
            frames += 1
            place += 11 + (3 << (m[place + 9] & 7) + 1 if m[place + 9] & 128 else 0)
        elif kind == 0x21:
            place += 2
        else:
            return None
        while place < len(m) and m[place]:
            place += 1 + m[place]
        place += 1
    return None


#: Magic bytes of each type, with its writer and its validator.
FORMATS = {
    "audio/wav": (b"RIFF", _wav, _read_wav),
    "audio/basic": (b".snd", _au, _read_au),
    "image/x-portable-graymap": (b"P5", _pgm, _read_pgm),
    "image/bmp": (b"BM", _bmp, _read_bmp),
    "image/png": (b"\x89PNG\r\n\x1a\n", _png, _read_png),
}
ONLY_READ = {"image/gif": ((b"GIF87a", b"GIF89a"), _read_gif)}
WRITERS = list(FORMATS)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, (magic, _, _) in FORMATS.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    for kind, (magics, _) in ONLY_READ.items():
        for magic in magics:
            a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def payload(raw: bytes) -> bytes:
    """raw, filled up to a positive multiple of UNIT."""
    return raw + FILL * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(data: bytes, kind: str) -> bytes:
    """data, a multiple of UNIT bytes, as a file of that type."""
    return FORMATS[kind][1](data)


def sniff(media: bytes, automaton: ahocorasick.Automaton, depth: int = 0) -> list[tuple[str, int, int, bytes, int]]:
    """(type, offset, length, samples, depth) of every file that a validator confirms, outermost first; the
    inside of a file found is searched as well. Where samples aren't stored as they are, files in them
    follow, a depth further in, with their offset in the samples."""
    out, inner = [], []
    for end, (n, kind) in automaton.iter(media.decode("latin-1")):
        at = end + 1 - n
        read = FORMATS[kind][2] if kind in FORMATS else ONLY_READ[kind][1]
        if (got := read(media, at)) is not None:
            out.append((kind, at, *got, depth))
            if got[1] and media.find(got[1], at, at + got[0]) < 0:
                inner += [x for x in sniff(got[1], automaton, depth + 1) if x[4] > depth + 1 or media.find(got[1][x[1] : x[1] + x[2]]) < 0]
    return out + inner


OUT = "doc_id bigint, n_bytes bigint, declared string, type string, media binary, samples binary, embedded array<struct<type:string,offset:bigint,length:bigint>>, mean double, deviation double"


def _files(batches):
    automaton = _automaton()
    for whole in batches:
        for b in tb.pieces(whole):
            rows = []
            given = b.column("declared").to_pylist() if "declared" in b.schema.names else None
            for i, raw in enumerate(b.column("text").cast(pa.binary()).fill_null(b"").to_pylist()):
                data = payload(raw)
                mark = zlib.crc32(raw)
                media = store(data, WRITERS[mark % len(WRITERS)])
                found = sniff(media, automaton)
                kind, _, _, samples, _ = next(x for x in found if x[1] == 0)
                hist = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
                mean = float(hist @ np.arange(256)) / len(samples)
                rows.append((len(raw), given[i] if given else WRITERS[mark // 8 % len(WRITERS)], kind, media, samples, [{"type": x[0], "offset": x[1], "length": x[2]} for x in found if x[1] or x[4]], mean, float(np.sqrt(hist @ (np.arange(256) - mean) ** 2 / len(samples)))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])), pa.float64(), pa.float64()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[x.split()[0] for x in OUT.split(", ")])


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = None) -> DataFrame:
    """For every row of docs its text as a media file and what sniffing finds in it: doc_id, n_bytes,
    declared (declared_col's, or a type that a careless source might give), type (the confirmed one), media, samples
    (read back), embedded (files carved out of the inside), mean and deviation of the samples.

    The format follows from the text alone, so equal texts have equal values. A null text is empty; an
    empty text is one unit of fill bytes. Extra columns are ignored.
    """
    rows = common.documents(docs, id_col, text_col)
    if declared_col is not None:
        rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{declared_col}`").cast("string").alias("declared"))
    return rows.mapInArrow(_files, OUT)
