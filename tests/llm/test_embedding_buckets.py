"""The embedding operator's buckets of one task: small and large ones, over several batches; codes by size."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evalloom.llm import embedding_dedup as ed


def test_shape_follows_the_rows():
    same = 1 - np.arccos(0.98) / np.pi
    for rows in (0, 1, 1000, 60_000, 10**9):
        tables, bits = ed.shape(rows, 0.98)
        assert bits >= ed.LEAST_BITS and (2**bits >= 16 * rows or not rows)
        assert (1 - same**bits) ** tables <= ed.MISS
    assert ed.shape(1000, 0.98) == (24, 14)
    assert ed.shape(10**6, 0.5)[0] <= ed.MOST_TABLES and ed.shape(100, 1.0)[0] == 1


@pytest.mark.parametrize("step", [11, 100, 10_000])
def test_compared(step):
    rng = np.random.default_rng(5)
    rows = []
    for label, dim in ((0, 8), (0, 5), (1, 8)):
        base = rng.standard_normal((20, dim))
        for t in range(3):
            for code, size in enumerate((2, 3, 1, ed.SMALL, ed.SMALL + 1, 150)):
                for i in range(size):
                    v = base[rng.integers(20)] + 0.05 * rng.standard_normal(dim)
                    rows.append((label, dim, t, code, 0, 0, 0, len(rows) + 1, int(rng.integers(1, 4)), v / np.linalg.norm(v), rng.integers(0, 3, 3)))
            for i in range(90):
                v = base[rng.integers(20)] + 0.05 * rng.standard_normal(dim)
                rows.append((label, dim, t, 9, 0, 1, i % 2, len(rows) + 1, 1, v / np.linalg.norm(v), rng.integers(0, 3, 3)))
    names = ["label", "dim", "t", "code", "bi", "bj", "side", "vec_id", "copies", "vector", "codes"]
    whole = pa.table([[r[0] for r in rows], pa.array([r[1] for r in rows], pa.int32()), *([r[k] for r in rows] for k in range(2, 9)), [r[9].tobytes() for r in rows], [r[10].tolist() for r in rows]], names=names)
    got, joined = Counter(), set()
    for b in ed._compared(0.98)(iter(whole.to_batches(step))):
        for vec_id, n, other in zip(*(b.column(c).to_pylist() for c in ("vec_id", "n", "other")), strict=True):
            if other is None:
                got[vec_id] += n
            else:
                joined.add((vec_id, other))
    want, up = Counter(), {r[7]: r[7] for r in rows}

    def root(i, up):
        while up[i] != i:
            i = up[i]
        return i

    for i, r in enumerate(rows):
        for s in rows[:i]:
            if r[:6] == s[:6] and (r[4] == r[5] or r[6] != s[6]) and r[9] @ s[9] >= 0.98:
                p, q = root(r[7], up), root(s[7], up)
                up[max(p, q)] = min(p, q)
                if (r[10][: r[2]] != s[10][: r[2]]).all():
                    want[r[7]] += s[8]
                    want[s[7]] += r[8]
    assert got == want and sum(want.values()) > 1000
    assert joined == {(i, root(i, up)) for i in up if root(i, up) != i}
