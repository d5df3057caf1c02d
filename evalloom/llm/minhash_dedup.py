"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact checks.

A text's set holds the hashes of its five-word shingles. Its sketch has one register for each of
M hash functions: the smallest exponentially distributed value, on a logarithmic scale and cut to
16 bits. Registers of a union are the maxima of the parts' registers, so sketches merge; two sets
agree in a register about as often as their Jaccard similarity. Texts that agree in a whole band
are candidates; a maximum-likelihood estimate from all registers drops hopeless ones, and what is
left is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Registers, rows of a band at most, base and rate of the sketch, largest register value.
M, ROWS, BASE, RATE, TOP = 64, 4, 1.001, 20.0, 65535
#: Chance that two texts at the threshold, without others near them, share no band: at most this.
MISS = 1e-5
#: Candidates are confirmed when the estimate is no further than this below the threshold:
#: five standard errors of an estimate from 64 registers near 0.85.
SLACK = 0.25
#: Members that one task compares with their hub before the hub's group is split further.
GROUP = 2000
#: Members of a band that one block holds when those of different components are compared.
BLOCK = 512
#: Ids that are sent to all executors at most (8 bytes each); more are joined by shuffling the texts.
FEW = 500_000
#: Turns of comparing buckets with a hub, the last of which compares all their remaining pairs, in blocks.
MOST_TURNS = 2

_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SUMMANDS = _rng.integers(1, 2**63, M, dtype=np.uint64)


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketches (texts x M, uint16) of sets laid end to end; all 0 for an empty set."""
    out = np.zeros((len(first) - 1, M), dtype=np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for j in range(M):
            low = np.minimum.reduceat(h * FACTORS[j] + SUMMANDS[j], first[full])
            x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
            out[full, j] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of sketch pairs, from how many registers are greater,
    smaller and equal, given the sets' sizes; on a grid of `steps` + 1 values up to the largest possible."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    fit = more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.clip(1 - up - down, 1e-12, None))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def band_rows(share: int) -> int:
    """Registers of a band: as many as the threshold allows, which leaves a pair at it a chance of at
    most MISS to share no band. 4 (7e-6) at 0.85, 3 (3e-7) at 0.8; 1 where no number will do, under 0.17."""
    s = share / 100
    return next((r for r in range(ROWS, 0, -1) if (1 - s**r) ** (M // r) <= MISS), 1)


def _sketch(per_band: int):
    bands = M // per_band

    def run(batches):
        ints = np.arange(bands, dtype=np.uint64)
        for whole in batches:
            for batch in tb.pieces(whole, most=tb.SMALL):
                h, first = tb.shingle_sets(batch.column("text"))
                sizes = np.diff(first)
                regs = registers(h, first)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (tb.mix(h * np.uint64(3) + np.uint64(1)), tb.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))]
                set_hash = [s[first[1:]] - s[first[:-1]] for s in sums]
                key = np.zeros((len(sizes), bands), dtype=np.uint64)
                for r in range(per_band):
                    key = key * np.uint64(0x9FB21C651E98DF25) + regs[:, r : bands * per_band : per_band].astype(np.uint64) + np.uint64(1)
                key = tb.mix(key * np.uint64(64) + ints[None, :]).view(np.int64)
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(set_hash[0].view(np.int64)),
                        pa.array(set_hash[1].view(np.int64)),
                        pa.array([x.tobytes() for x in regs], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * key.shape[1], pa.array(key.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "registers", "bands"],
                )

    return run


SKETCH = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, registers binary, bands array<bigint>"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 80) -> DataFrame:
    """One row per text: set size, a 128-bit hash of the set, registers and band keys."""
    return common.documents(docs, id_col, text_col).mapInArrow(_sketch(band_rows(share)), SKETCH)


def _likely(threshold: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, M) for c in ("registers_a", "registers_b")]
            sizes = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            keep = (joint_estimate(*regs, *sizes) >= threshold - SLACK) & (np.minimum(*sizes) >= threshold * np.maximum(*sizes))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(share: int):
    """100 * intersection >= share * union, on the whole sets; rows come sorted with a hub before its members."""

    def run(batches):
        hub, hub_set = None, None
        for whole in batches:
            for b in tb.pieces(whole, most=tb.SMALL):
                h, first = tb.shingle_sets(b.column("text"))
                a, ids = b.column("hub").to_pylist(), b.column("doc_id").to_pylist()
                member = b.column("member").to_pylist()
                out = []
                for i in range(b.num_rows):
                    own = h[first[i] : first[i + 1]]
                    if not member[i]:
                        if hub != a[i]:
                            hub, hub_set = a[i], []
                        hub_set.append(own)
                    elif hub == a[i]:
                        for s in hub_set:
                            both = len(np.intersect1d(s, own, assume_unique=True))
                            if len(own) and 100 * both >= share * (len(s) + len(own) - both):
                                out.append((a[i], ids[i]))
                                break
                if out:
                    yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts with one of these doc_ids, a stored table. Up to FEW ids are sent to the texts; Spark alone
    would shuffle all texts as soon as the ids pass its threshold for broadcasts."""
    need = common.stored(ids.distinct(), "need")
    return common.stored(texts.join(F.broadcast(need) if need.count() <= FEW else need, "doc_id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Those of pairs (a, b) that the estimate and then the full sets support."""
    side = classes.select("doc_id", "n_shingles", "registers")
    for c in ("a", "b"):
        pairs = pairs.join(side.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"registers_{c}")), c)
    likely = common.stored(pairs.mapInArrow(_likely(share / 100), "a bigint, b bigint"), "likely")
    texts = _texts_of(texts, likely.select(F.explode(F.array("a", "b")).alias("doc_id")))
    split = likely.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    hubs = (
        split.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .join(texts.withColumnRenamed("doc_id", "hub"), "hub")
        .select("hub", "part", F.lit(False).alias("member"), F.col("hub").alias("doc_id"), "text")
    )
    members = (
        likely.join(split, "a")
        .select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), F.col("b").alias("doc_id"))
        .join(texts, "doc_id")
        .select("hub", "part", "member", "doc_id", "text")
    )
    rows = hubs.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return rows.mapInArrow(_confirm(share), "a bigint, b bigint")


def _cells(batches, need):
    """The rows of each cell (band, i, j), which come sorted by cell, as one table with row numbers."""
    open_, key = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if open_:
                    yield key, pa.Table.from_batches(open_)
                open_, key = [], keys[at]
            open_.append(batch.slice(at, end - at).select(need))
            at = end
    if open_:
        yield key, pa.Table.from_batches(open_)


def _partners(cell: tuple, t: pa.Table, threshold: float):
    """For each row of a cell, the later rows of other components that the sketches leave as partners,
    where this cell is the first one that holds both."""
    i, j = cell[1:]
    per_band = band_rows(round(100 * threshold))
    bands = M // per_band
    regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, M)
    n, part, block, at = (t.column(c).to_numpy() for c in ("n_shingles", "part", "block", "at"))
    for x in range(len(n) - 1):
        y = np.arange(x + 1, len(n))
        y = y[(part[y] != part[x]) & (np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]))]
        if i != j:
            y = y[block[y] != block[x]]
        same = (regs[y] == regs[x])[:, : bands * per_band].reshape(len(y), bands, per_band)
        y = y[same.all(2)[:, : at[x]].sum(1) == 0]
        if len(y):
            one = np.broadcast_to(regs[x], (len(y), M))
            y = y[joint_estimate(regs[y], one, n[y].astype(float), np.full(len(y), float(n[x]))) >= threshold - SLACK]
        yield x, y


CELL = ["b", "part", "block", "at", "n_shingles", "registers"]


def _hopeful(threshold: float):
    def run(batches):
        for key, t in _cells(batches, CELL):
            keep = np.zeros(t.num_rows, bool)
            for x, y in _partners(key, t, threshold):
                keep[y] = True
                keep[x] |= len(y) > 0
            b = t.column("b").filter(pa.array(keep)).combine_chunks()
            yield pa.record_batch([*(pa.array([k] * len(b), kind) for k, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), b], names=["band", "i", "j", "b"])

    return run


def _linked(share: int):
    """Links on the whole sets; parts that a cell has joined already need no other link from it."""

    def run(batches):
        for key, t in _cells(batches, [*CELL, "text"]):
            sets = []
            for piece in t.select(["text"]).combine_chunks().to_batches():
                for b in tb.pieces(piece, most=tb.SMALL):
                    h, first = tb.shingle_sets(b.column("text"))
                    sets += [h[first[k] : first[k + 1]] for k in range(b.num_rows)]
            ids, part = t.column("b").to_numpy(), t.column("part").to_numpy().copy()
            out = []
            for x, ys in _partners(key, t, share / 100):
                for y in ys:
                    if part[x] != part[y]:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= share * (len(sets[x]) + len(sets[y]) - both):
                            out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                            part[part == part[y]] = part[x]
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def separated(rows: DataFrame, texts: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between the members of each band (band, b, part, n) that lie in different parts.

    A band's members are dealt into blocks, and each two blocks meet in a cell, so a task holds two
    blocks at most. Sketches alone tell which members need their texts there; pairs stay inside the
    task, and a pair that meets in several bands is compared in the first of them.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.select("band", "b", "part", blocks.alias("blocks"), F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    dealt = dealt.join(classes.select(F.col("doc_id").alias("b"), "n_shingles", "registers", "bands"), "b")
    dealt = dealt.select("band", "b", "part", "block", "blocks", "n_shingles", "registers", (F.expr("array_position(bands, band)") - 1).cast("int").alias("at"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *CELL)
    order = ("band", "i", "j")
    sorted_ = cells.repartition(*order).sortWithinPartitions(*order, "b")
    need = common.stored(sorted_.mapInArrow(_hopeful(share / 100), "band bigint, i int, j int, b bigint"), "hopeful")
    some = _texts_of(texts, need.select(F.col("b").alias("doc_id"))).withColumnRenamed("doc_id", "b")
    full = cells.join(need, [*order, "b"]).join(some, "b").select(*order, *CELL, "text")
    return full.repartition(*order).sortWithinPartitions(*order, "b").mapInArrow(_linked(share), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: texts whose five-word shingle
    sets are similar to at least share per cent are linked, components take their smallest doc_id.

    Equal sets are one class. In every band bucket the classes are first compared with the
    one that meets most others in all its buckets. While the links found so far leave many pairs of a bucket in different
    components, another member of it is compared with all of other components; at last all pairs
    that lie in different components are, in blocks. Comparisons inside a component can't change the result,
    so leaving them out loses nothing, and a bucket of any number of near copies costs a few
    comparisons a member.

    Null and empty texts have no shingles and link with nothing. Rows with the same doc_id are one
    node, whatever their texts. Rows without doc_id link with nothing and get null component_id and
    kept. Extra columns are ignored.
    """
    base = common.documents(docs, id_col, text_col)
    sk = common.stored(base.mapInArrow(_sketch(band_rows(share)), SKETCH), "sketch")
    classes = (
        sk.where("n_shingles > 0 and doc_id is not null")
        .groupBy("h1", "h2")
        .agg(F.min_by(F.struct("doc_id", "n_shingles", "registers", "bands"), "doc_id").alias("x"), F.max("doc_id").alias("last"))
        .select("h1", "h2", "x.*")
    )
    classes = common.stored(classes, "classes")
    rows = classes.select(F.explode("bands").alias("band"), F.col("doc_id").alias("b"))
    crowd = rows.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    rows = common.stored(rows.join(crowd, "band"), "buckets")
    # The text in the middle of a group of near copies meets more of them than any copy does.
    middle = rows.groupBy("b").agg(F.sum("crowd").alias("weight"))
    inside = common.stored(rows.drop("crowd").join(middle, "b"), "buckets")
    hub = inside.groupBy("band").agg(F.max_by("b", F.struct("weight", -F.col("b"))).alias("a"))
    first = inside.join(hub, "band").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    texts = base.where("doc_id is not null and text is not null")
    held = sk.where("doc_id is not null").join(classes.select("h1", "h2", F.col("doc_id").alias("node")), ["h1", "h2"])
    several = held.groupBy("doc_id").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p < q")
    ties = held.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    hubs = common.stored(confirmed(first, texts, classes, share).union(ties), "links")
    found, connected = hubs, common.connected_components(hubs)
    for turn in range(MOST_TURNS):
        rows = inside.join(connected.withColumnRenamed("node", "b"), "b", "left").select("band", "b", F.coalesce("component", "b").alias("part"))
        sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("parts"))
        mixed = sizes.where("parts > 1 and n > 2").withColumn("pairs", (F.col("n") * F.col("n") - F.col("squares")) / 2)
        rows = common.stored(rows.join(mixed.select("band", "n", "pairs"), "band"), "mixed")
        members, pairs = rows.agg(F.count("*"), F.sum(F.col("pairs") / F.col("n"))).first()
        if not members:
            break
        last = pairs <= 4 * members or turn == MOST_TURNS - 1
        if last:  # all pairs that lie in different components
            more = common.stored(separated(rows, texts, classes, share), "links")
        else:  # another hub for each bucket
            hub = rows.groupBy("band").agg(F.min_by(F.struct(F.col("b").alias("a"), F.col("part").alias("hub_part")), F.xxhash64("b", F.lit(turn))).alias("x")).select("band", "x.*")
            pairs = rows.join(hub, "band").where("part <> hub_part").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            more = common.stored(confirmed(pairs.distinct(), texts, classes, share), "links")
        found = found.union(more)
        connected = common.connected_components(found)
        if last:
            break
    members = sk.join(classes.select("h1", "h2", F.col("doc_id").alias("node")), ["h1", "h2"], "left")
    return (
        members.join(connected, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def one_of_each(docs: DataFrame, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those rows of docs, with all columns, that near_duplicates() keeps; of rows with one doc_id, the one
    whose text has the least hash. Rows without doc_id stay."""
    kept = near_duplicates(docs, share, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"))
    found = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    found = found.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("text_hash"))).where("turn = 1").select("row")
    return found.union(rows.where("id is null").select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
