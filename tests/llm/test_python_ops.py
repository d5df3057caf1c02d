"""Operators 1, 2, 4, 8, 9 and 10 against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import language_id, license_scan, media_sniff, minhash_dedup, packing, suffix_dedup

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "\0" * 700), (6, "x " * 3000)]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def frame(spark, rows):
    """With extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit(1).alias("start"), F.lit("q").alias("source"), F.lit(None).cast("string").alias("th"), F.lit(0).alias("length"), F.lit("x").alias("node"), F.lit(2).alias("size"))


def repeats(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = defaultdict(list)
    for i, b in enumerate(texts):
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]].append((i, p))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + n] = b"\1" * n
    out = []
    for (doc_id, _), b, g in zip(rows, texts, gone, strict=True):
        out.append((doc_id, len(b), sum(g), len(re.findall(rb"\x01+", bytes(g))), hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [64, 400])
def test_suffix_dedup(spark, n):
    rng = random.Random(n)
    base = "".join(rng.choice("abc défg\n") for _ in range(9000))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(8000)
            parts += [base[a : a + rng.randrange(900)], "".join(rng.choice("xyzé ") for _ in range(rng.randrange(200)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 3000), (101, "ab" * 700), (104, rows[3][1]), (105, "\0" * 450 + "q"), (106, "z" + "\0" * 449), (107, "a" * 399), *ODD]
    got = suffix_dedup.remove_repeats(frame(spark, rows), n).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str)
    assert got == repeats(rows, n)
    assert sum(r[2] for r in got)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows, share):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= share * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


@pytest.mark.parametrize(("block", "turns"), [(512, 2), (7, 1)])
def test_near_duplicates(spark, monkeypatch, block, turns):
    """With bands of one block, and of many that meet two by two."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "MOST_TURNS", turns)
    separated, most = minhash_dedup.separated, []
    monkeypatch.setattr(minhash_dedup, "separated", lambda rows, *rest: most.append(rows.agg(F.max("n")).first()[0]) or separated(rows, *rest))
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base if i % 3 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i + 10, " ".join(w)))
    rows += [(500, "A b  C\nd"), (501, "a B c d"), *ODD]
    for share in (80, 85):
        got = minhash_dedup.near_duplicates(frame(spark, rows), share).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows, share)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert max(most) > 2 * 7 if block == 7 else most


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    regs = [minhash_dedup.registers(x, np.array([0, len(x)])) for x in (a, b, np.union1d(a, b))]
    assert (minhash_dedup.merged(regs[0], regs[1]) == regs[2]).all()
    assert abs(minhash_dedup.joint_estimate(regs[0], regs[1], np.array([2000.0]), np.array([2000.0]))[0] - 0.6) < 0.2


def test_license_base_places(spark):
    license_ = [(20, "x Under the MIT-license, under the mit license."), (21, "CC BY-NC 4.0 and Licensed under CC BY-NC 4.0"), (22, "Released under the MIT License."), (23, "This work is licensed under the GNU General Public License, version 3."), (24, "the mit"), (25, "license"), (26, "under the"), (27, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software")]
    rows = license_ + ODD
    phrases = {tuple(p.split()): label for p, label in license_scan.BASE.items()}
    got = {}
    for r in license_scan.scan(frame(spark, rows)).collect():
        base = [x.word for x in r.places if x.base]
        got.setdefault(r.doc_id, []).append((r.n_words, len(base), min(base, default=None), max(base, default=None), sorted({x.label for x in r.places if x.base}), sorted({x.label for x in r.places})))
    for doc_id, text in rows:
        w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        want = (len(w), len(at), min((x[0] for x in at), default=None), max((x[0] for x in at), default=None), sorted({x[1] for x in at}))
        assert want in [x[:5] for x in got[doc_id]], (doc_id, want, got[doc_id])
        assert all(set(x[4]) <= set(x[5]) for x in got[doc_id])
    assert got[23][0][5] == ["gpl-3"] and got[27][0][5] == ["mit"] and got[20][0][1] == 2


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
    rows = [tuple(r) for r in docs] + [(900, "a  b \n c\t d  "), (901, " x\n y \t\nz 's 're'll don't <|endoftext|>"), (902, "\x1c q   r　 s"), *ODD]
    df = frame(spark, rows)
    ids = defaultdict(list)
    for r in packing.pieces(df, path, 2048).collect():
        ids[r.doc_id].append((r.start, bytes(r.ids), r.ids_crc32, r.doc_tokens))
    for doc_id, text in rows:
        e = reference.encode(text or "", add_special_tokens=False).ids
        want = struct.pack(f"<{len(e) + 1}I", *e, 1)
        pieces = {s: b for s, b, _, n in ids[doc_id] if n == len(want) // 4}
        assert b"".join(pieces[s] for s in sorted(pieces)) == want, (doc_id, text)
    assert all(zlib.crc32(b) == c for p in ids.values() for _, b, c, _ in p)
    got = packing.pack(df, path, 2048).collect()
    assert len(got) == sum(map(len, ids.values()))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for p in by.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) * 1.05 + 2
    assert Counter(r.doc_id for r in got) == Counter({k: len(v) for k, v in ids.items()})


def test_shortest_pack_first_places_everything():
    rng = random.Random(1)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 2049), 500)}
    placed = Counter()
    for pattern, count in packing.shortest_pack_first(histogram, 2048):
        assert sum(pattern) <= 2048
        for n in pattern:
            placed[n] += count
    assert placed == histogram
    assert packing.shortest_pack_first({}, 2048) == []


def test_media_round_trip(spark):
    rows = [(i, "t" * i + "é") for i in range(30)] + [(50, "RIFF BM P5\n24 1\n255\n" + "q" * 24 + "GIF89a"), *ODD]
    got = media_sniff.files(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for doc_id, text in rows:
        raw = (text or "").encode()
        r = by[doc_id, len(raw)]
        assert bytes(r.samples) == media_sniff.payload(raw) and len(r.samples) % 576 == 0 and len(r.samples) > 0
    assert any(x.type == "image/x-portable-graymap" for x in by[50, 50].embedded)
    a = media_sniff._automaton()
    for kind in media_sniff.WRITERS:
        data = bytes(range(256)) * 9
        media = media_sniff.store(data, kind)
        assert [(x[0], x[1], x[2], x[3]) for x in media_sniff.sniff(media, a)][0] == (kind, 0, len(media), data)
        assert not [x for x in media_sniff.sniff(media[:-1], a) if x[1] == 0]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.trained(docs)
    got = language_id.identify(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.97
    odd = {r.doc_id: r for r in language_id.identify(frame(spark, [*ODD, (30, "12 34 !"), (31, "ß"), (32, "中")]), model).collect() if r.doc_id is not None}
    assert [odd[i].lang_pred for i in (1, 2, 3, 30)] == ["und"] * 4
    assert odd[31].lang_pred != "und" and odd[32].lang_pred != "und" and 0 <= odd[32].score <= 1
    assert language_id.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None


def test_empty_tables(spark):
    none = frame(spark, [])
    assert not suffix_dedup.remove_repeats(none).collect()
    assert not minhash_dedup.near_duplicates(none).collect()
    assert not license_scan.scan(none).collect()
    assert not media_sniff.files(none).collect()
    assert not language_id.identify(none, None).collect()
    public = pytest.importorskip("public_tokenizers")
    assert not packing.pack(none, public.path("byte_bpe_50k.json")).collect()
