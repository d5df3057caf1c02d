"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, rolling hashes, shingles.

All functions take the bytes of several texts laid end to end and their offsets; nothing crosses
from one text to the next. Hashes are 64-bit polynomials over randomised bytes; a hash of any
stretch is two look-ups in a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = tuple(_rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in BASES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that operators with many arrays a byte look at together: some 16 MB of arrays.
SMALL = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _running_product(factor: U, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        inverse = U(pow(int(BASES[which]), -1, 1 << 64))
        have = _powers[which] = (_running_product(BASES[which], size), _running_product(inverse, size))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Rolling:
    """Hashes of stretches [start, end) of data."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.forward, self.back = powers(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * self.forward[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0] if len(column) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes of text, at least a row each: bounds a worker's memory."""
    if not batch.num_rows:
        return
    lengths = np.diff(laid_out(batch.column(text))[1])
    total, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        past = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, past + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = separator[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, sep[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, sep[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(before & ~sep)
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words of each text, sorted within the text, and each text's
    first index among them (n + 1 values). A text of 1 to k - 1 words has one, its whole sequence."""
    counts = np.diff(first)
    n_docs, n = len(counts), len(word_hash)
    doc = np.repeat(np.arange(n_docs), np.maximum(counts - k + 1, np.minimum(counts, 1)))
    per = np.maximum(counts - k + 1, np.minimum(counts, 1))
    begin = np.repeat(first[:-1], per) + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    h = np.zeros(len(doc), dtype=np.uint64)
    left = counts[doc]
    for i in range(k):
        at = begin + i
        use = i < left if len(left) and left.min() < k else None
        w = word_hash[np.minimum(at, n - 1)] if n else word_hash
        step = h * U(0x9FB21C651E98DF25) + w
        h = step if use is None else np.where(use, step, h * U(0x9FB21C651E98DF25) + U(0x5851F42D4C957F2D))
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of the lower-cased words of a string column."""
    data, offsets = laid_out(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return shingles(Rolling(data).of(starts, ends), first, k)
