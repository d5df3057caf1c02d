"""Near-duplicate vectors by sign hashing in several tables, exact checks and connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chance that a pair at the threshold shares no code in any table, at most.
MISS = 6e-6
#: Bits of a code at least, and tables at most; beyond these a code gets fewer bits.
LEAST_BITS, MOST_TABLES = 14, 512
#: Vectors of a bucket that one step compares with as many others.
BLOCK = 1024
#: Buckets of up to so many vectors are compared together, many in a step.
SMALL = 64
#: Cosines this close to the threshold are summed again in one fixed order, so that every bucket finds the same.
CLOSE = 1e-9
VECTOR = "vec_id bigint, label bigint, dim int, h1 bigint, h2 bigint, vector binary"


def shape(rows: int, least: float) -> tuple[int, int]:
    """Tables and bits for labels of up to `rows` vectors.

    Four bits more than a number of the rows takes leave a vector a sixteenth of a chance neighbour in a
    table, at every size, so the candidates grow with the rows and not with their square. The tables
    follow from the bits and MISS: 24 of 14, 31 of 17, 57 of 25.
    """
    same = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1))) + 4)
    while True:
        chance = same**bits
        tables = 1 if chance > 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-chance)) if chance > 1e-12 else MOST_TABLES + 1
        if tables <= MOST_TABLES or bits == 1:
            return min(tables, MOST_TABLES), min(bits, 62)
        bits -= 1


def _hashed(batches):
    """Vectors that can have links, scaled to length 1, with two hashes of their values."""
    for b in batches:
        rows: dict[int, list] = {}
        for vec_id, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("vector").to_pylist(), strict=True):
            if label is not None and v and None not in v:
                rows.setdefault(len(v), []).append((vec_id, label, v))
        for dim, found in rows.items():
            x = np.array([r[2] for r in found], dtype=np.float64)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(1, keepdims=True)
                use = np.isfinite(x).all(1) & (top[:, 0] > 0)
                x, found = x[use] + 0.0, [r for r, ok in zip(found, use, strict=True) if ok]
                scaled = x / top[use]
            if not len(x):
                continue
            scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
            bits = x.view(np.uint64).reshape(len(x), dim)
            hashes = [((bits ^ (bits >> np.uint64(29))) * np.random.default_rng(s).integers(1, 2**63, dim, dtype=np.uint64)[None, :] * np.uint64(2) + np.uint64(1)).sum(1, dtype=np.uint64).view(np.int64) for s in (5, 6)]
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in found], pa.int64()),
                    pa.array([r[1] for r in found], pa.int64()),
                    pa.array([dim] * len(x), pa.int32()),
                    pa.array(hashes[0]),
                    pa.array(hashes[1]),
                    pa.array([r.tobytes() for r in scaled], pa.binary()),
                ],
                names=[z.split()[0] for z in VECTOR.split(", ")],
            )


def _coded(tables: int, bits: int):
    """The rows with the codes of their vectors: the sides of `bits` hyperplanes for each table."""

    def run(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes = np.zeros((b.num_rows, tables), dtype=np.int64)
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(97 + dim).standard_normal((dim, tables * bits), dtype=np.float32)
                some = np.flatnonzero(dims == dim)
                x = _vectors(b.column("vector").take(pa.array(some)), dim).astype(np.float32)
                codes[some] = ((x @ planes[dim]) > 0).reshape(len(some), tables, bits) @ weights
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * tables, pa.array(codes.ravel()))], names=[*b.schema.names, "codes"])

    return run


def _vectors(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _compared(least: float):
    """Rows sorted by bucket and pair of blocks: for each vector the vectors it is linked with here,
    counted where the pair first shares a code, and an edge to the smallest vector it is joined to."""
    keys = ("label", "dim", "t", "code", "bi", "bj")

    def exact(x, a, c):
        return np.einsum("nd,nd->n", x[a], x[c]) >= least

    def unseen(codes, table, a, c):
        """The pairs that share no code of a table before their bucket's."""
        left = np.arange(len(a))
        for k in range(int(table[a].max(initial=0))):
            left = left[(table[a[left]] <= k) | (codes[a[left], k] != codes[c[left], k])]
        return a[left], c[left]

    def small(x, group):
        """Linked pairs inside groups of few rows, all rows at once."""
        for far in range(1, SMALL):
            a = np.flatnonzero(group[far:] == group[:-far])
            if not len(a):
                return
            a = a[exact(x, a, a + far)]
            yield a, a + far

    def large(x, left, right, same):
        for i in range(0, len(left), BLOCK):
            a = left[i : i + BLOCK]
            for j in range(i if same else 0, len(right), BLOCK):
                c = right[j : j + BLOCK]
                cosine = x[a] @ x[c].T
                near = cosine >= least
                p, q = np.nonzero(np.abs(cosine - least) < CLOSE)
                near[p, q] = exact(x, a[p], c[q])
                p, q = np.nonzero(near)
                if same and j == i:
                    p, q = p[p < q], q[p < q]
                yield a[p], c[q]

    def found(x, group, begin, end, same, side):
        """Linked pairs of all groups."""
        little = same & (end - begin <= SMALL)
        some = np.flatnonzero(little[group])
        for a, c in small(x[some], group[some]):
            yield some[a], some[c]
        for g in np.flatnonzero(~little):
            rows = np.arange(begin[g], end[g])
            yield from large(x, rows, rows, True) if same[g] else large(x, rows[side[rows] == 0], rows[side[rows] == 1], False)

    def done(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        dims = t["dim"].to_numpy()
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = t.slice(s, e - s).combine_chunks()
            key = np.stack([part[c].to_numpy() for c in keys])
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            x = _vectors(part["vector"], dims[s])
            codes = part["codes"].combine_chunks().flatten().to_numpy().reshape(e - s, -1)
            ids, copies, table, side = (part[c].to_numpy() for c in ("vec_id", "copies", "t", "side"))
            count, edges = np.zeros(e - s, dtype=np.int64), np.zeros((2, 0), dtype=np.int64)
            for a, c in found(x, group, begin, np.append(begin[1:], e - s), key[4, begin] == key[5, begin], side):
                if len(a):
                    # only what joins parts together is kept
                    edges = _forest(np.concatenate([edges, np.stack([a, c])], axis=1), e - s)
                    a, c = unseen(codes, table, a, c)
                    count += np.bincount(a, weights=copies[c], minlength=e - s).astype(np.int64)
                    count += np.bincount(c, weights=copies[a], minlength=e - s).astype(np.int64)
            some = np.flatnonzero(count)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([ids[some], ids[edges[0]]])),
                    pa.array(np.concatenate([count[some], np.zeros(edges.shape[1], dtype=np.int64)])),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[edges[1]])]),
                ],
                names=["vec_id", "n", "other"],
            )

    def run(batches):
        held, last = [], None  # the rows of a bucket that may go on
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in keys])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and (len(cut) or tuple(key[:, 0]) != last):
                goes_on = tuple(key[:, 0]) == last
                yield from done([*held, b.slice(0, cut[0])] if goes_on else held)
                held = []
                if goes_on:
                    b, cut = b.slice(cut[0]), cut[1:] - cut[0]
            if len(cut):
                yield from done([b.slice(0, cut[-1])])
                b = b.slice(cut[-1])
            held.append(b)
            last = tuple(key[:, -1])
        if held:
            yield from done(held)

    return run


def _forest(edges: np.ndarray, n: int) -> np.ndarray:
    """Edges (member, smallest member) with the same components."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, edges[0], low[edges[1]])
        np.minimum.at(low, edges[1], low[edges[0]])
        low = low[low]
        if (low == before).all():
            break
    some = np.flatnonzero(low != np.arange(n))
    return np.stack([some, low[some]])


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: vectors of one label are linked when their
    cosine, in double precision, is at least `least`.

    Equal vectors form one class, with the number of its rows. Classes meet in buckets (label, table,
    code), whose tables and bits follow from the rows of the largest label, see shape(); a bucket of more
    than BLOCK classes is dealt out to pairs of blocks, which different tasks compare. Pairs aren't written out: a task returns each vector's number of links, counted only in
    the first table where the two agree, and a forest of the components.

    Vectors that are null, zero, or hold a null or non-finite component, and those without label or
    vec_id, link with nothing. Vectors of different lengths don't either. Rows that repeat a vec_id
    with equal vectors count as vectors of their own; with different vectors they are one node, whose
    links add up and whose components join. Extra columns are ignored.
    """
    base = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    hashed = common.stored(base.where("vec_id is not null").mapInArrow(_hashed, VECTOR), "vectors")
    most = hashed.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    key = ["label", "dim", "h1", "h2"]
    classes = hashed.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min_by("vector", "vec_id").alias("vector"))
    classes = common.stored(classes.mapInArrow(_coded(*shape(most, least)), f"{VECTOR.split('vec_id bigint, ')[1].split(', vector')[0]}, node bigint, copies bigint, vector binary, codes array<bigint>"), "classes")
    bucket = ["label", "dim", "t", "code"]
    rows = classes.select("label", "dim", "h1", F.col("node").alias("vec_id"), F.posexplode("codes").alias("t", "code"))
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("b"), j).alias("bi"), F.greatest(F.col("b"), j).alias("bj"), F.when(F.col("b") <= j, 0).otherwise(1).cast("int").alias("side")))
    rows = rows.join(sizes, bucket).withColumn("b", block).select(*bucket, "h1", "vec_id", F.explode(pairs).alias("p")).select(*bucket, "h1", "vec_id", "p.*")
    rows = rows.join(classes.select("label", "dim", "h1", F.col("node").alias("vec_id"), "copies", "vector", "codes"), ["vec_id", "label", "dim", "h1"])
    met = [*bucket, "bi", "bj"]
    found = common.stored(rows.repartition(*met).sortWithinPartitions(*met).select(*met, "side", "vec_id", "copies", "vector", "codes").mapInArrow(_compared(least), "vec_id bigint, n bigint, other bigint"), "links")
    links = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "node")
    nodes = hashed.select("vec_id", "label", "dim", "h1", "h2").join(classes.select(*key, "node", "copies"), key).join(links, "node", "left")
    nodes = common.stored(nodes.select("vec_id", "node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "nodes")
    several = nodes.groupBy("vec_id").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p < q").select("vec_id")
    ties = nodes.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    components = common.connected_components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")).union(ties))
    linked = nodes.join(components, "node", "left").select("vec_id", "n_links", F.coalesce("component", "node").alias("component_id"))
    valid = F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    alone = base.where(~F.coalesce(valid, F.lit(False)) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
