"""Files inside decoded samples, and common variants of each format that store() doesn't write."""

import struct
import zlib

import pytest

from evalloom.llm import media_sniff as ms

PGM = "P5\n24 1\n255\n" + "q" * 24


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(shape, data):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *shape)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def bmp(width, height, bits, rows):
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + rows


def test_every_format_is_searched_inside(spark):
    rows = [(i, f"text {i} {PGM}", "image/png" if i % 2 else None) for i in range(40)]
    assert {zlib.crc32(t.encode()) % 5 for _, t, _ in rows} == set(range(5))
    got = ms.files(spark.createDataFrame(rows, "doc_id long, text string, told string"), declared_col="told").collect()
    assert all([x.type for x in r.embedded] == ["image/x-portable-graymap"] for r in got)
    assert {r.doc_id: r.declared for r in got} == {i: t for i, _, t in rows}


@pytest.mark.parametrize(
    ("kind", "media", "samples"),
    [
        ("image/bmp", bmp(2, 2, 24, b"abcdef\0\0ghijkl\0\0"), b"ghijklabcdef"),
        ("image/bmp", bmp(4, 1, 8, b"abcd"), b"abcd"),
        ("image/png", png((2, 2, 8, 2, 0, 0, 0), b"\1" + bytes([1, 2, 3, 1, 1, 1]) + b"\2" + bytes([1] * 6)), bytes([1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])),
        ("image/png", png((3, 2, 8, 0, 0, 0, 0), b"\4" + bytes([5, 1, 1]) + b"\3" + bytes([2, 2, 2])), bytes([5, 6, 7, 4, 7, 9])),
        ("image/png", png((2, 2, 8, 0, 0, 0, 1), b"\0a\0b\0cd"), b"abcd"),
        ("audio/wav", b"RIFF" + struct.pack("<I", 4 + 24 + 12 + 12) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"LIST" + struct.pack("<I", 4) + b"INFO" + b"data" + struct.pack("<I", 4) + b"wxyz", b"wxyz"),
        ("audio/basic", b".snd" + struct.pack(">IIIII", 24, 4, 3, 8000, 1) + b"wxyz", b"wxyz"),
        ("audio/basic", b".snd" + struct.pack(">IIIII", 24, 0xFFFFFFFF, 1, 8000, 1) + b"wxyz", b"wxyz"),
        ("image/x-portable-graymap", b"P5 # note\n2 2\n65535\nabcdefgh", b"abcdefgh"),
        ("image/gif", b"GIF89a" + struct.pack("<HHBBB", 1, 1, 128, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2D\1\0;", b""),
    ],
)
def test_variants(kind, media, samples):
    found = [x[:4] for x in ms.sniff(media + b"??" * (kind != "audio/basic"), ms._automaton()) if x[1] == 0]
    assert found[0] == (kind, 0, len(media), samples)
    if media[8:12] != b"\xff" * 4:
        assert not [x for x in ms.sniff(media[:-1], ms._automaton()) if x[1] == 0]
